"""URL filter: rules first, then a logistic regression on hashed character
n-grams of host and path, trained from a small labelled URL table.

Defined results: a null URL, or one without ``://``, has an empty host and path;
no rule fits it and the model judges it by its intercept. Equal URLs get equal
verdicts. Without labelled URLs of both kinds every URL that no rule decides is
allowed. URLs of any length are taken whole; rows that repeat each give a row; columns
other than page_id and url are not read, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule): host, then the beginning of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/"))

#: Names of the default labelled hosts (fixed values); none is a host of the test tables.
_BLOCK = """
    grand-casino lucky-casino-club mobile-casino casino-spins royalcasino777 vegas-casino-room wincasino
    live-casino-win bigwin-slots winners-club instant-win win-cash-now jackpot-city mega-jackpot slots-heaven
    roulette-king sure-bets football-bets live-bets bets-and-odds best-bets-today betting-king sportsbetting
    bet-bonus poker-room online-poker-cash lottery-results-win bingo-bonus free-spins free-bonus-money
    free-gift-cards free-followers cheap-meds cheap-viagra cheapest-cialis cheap-replicas diet-pills
    sleeping-pills-shop weightloss-pills pills4less blue-pills-store rx-pharmacy canadian-pharmacy
    pharmacy-noscript no-prescription-meds steroids-shop hair-loss-miracle miracle-diet payday-cash quick-loan
    easy-loans-today bad-credit-loan instant-cash-advance debt-erase double-your-bitcoin crypto-doubler
    forex-millions get-rich-fast work-from-home-cash earn-money-easy adult-chat xxx-tube sexy-singles nude-cams
    hot-dates-tonight escorts-city porn-hd milf-cams keygen-world cracked-software warez-base serial-crack
    replica-rolex fake-handbags buy-likes seo-backlinks-cheap you-won-a-prize verify-account-now iphone-winner
    survey-rewards
""".split()
_ALLOW = """
    city-library public-library-hours university-press college-courses primary-school teachers-network
    history-museum art-gallery daily-herald morning-post evening-news the-observer local-weather storm-watchers
    climate-data ocean-science physics-notes chemistry-lab mathematics star-gazers garden-forum herb-growers
    bird-watching hiking-trails soup-recipes bread-bakers the-cheese-board home-cooking city-council
    county-records parliament-watch tax-office train-timetable bus-routes harbour-ferries cycling-club
    general-hospital family-health patient-advice nursing-journal open-source-docs python-notes compiler-design
    kernel-notes data-tables linux-help programming-forum web-standards short-stories poetry-archive
    book-reviews theatre-guide symphony-orchestra folk-music film-festival opera-house football-results
    athletics-club chess-association swimming-pool travel-diary mountain-huts northern-lights island-holidays
    charity-appeal animal-rescue community-hall farmers-market small-business trade-union bank-holidays
    insurance-explained pension-advice legal-aid housing-office job-centre apprenticeships language-exchange
    dictionary grammar-guide encyclopedia world-atlas national-parks wildlife-trust river-authority
    water-supply electric-cars railway-modellers sailing-school rowing-club tennis-courts cricket-scores
    knitting-patterns wood-workshop house-painting bicycle-repair camera-lenses vintage-radios coin-collectors
    family-trees village-history cathedral-choir youth-orchestra dance-academy weather-station child-care
    school-meals student-union research-council medical-library dental-practice eye-clinic
""".split()


def _url(i: int, name: str) -> str:
    """Both kinds of names get the same subdomains, endings and paths in turn, so these tell nothing."""
    return "https://{}{}.{}/{}/{}".format(("", "www.", "m.", "blog.", "")[i % 5], name, ("com", "org", "net")[i % 3],
                                          ("en", "fr", "de", "es")[i % 4], i * 37 % 97 + 1)


LABELLED_URLS = tuple((_url(i, n), y) for names, y in ((_BLOCK, 1), (_ALLOW, 0)) for i, n in enumerate(names))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, by plain text rules."""
    u = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    before = F.regexp_extract(after, r"^([^?#]*)", 1)
    host = F.regexp_extract(before, r"^([^/]*)", 1)
    path = F.substring(before, F.length(host) + 1, F.length(before))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def ngrams(host: Column, path: Column, n: int) -> Column:
    """Character n-grams of both parts, marked by part; texts below n give themselves."""
    def grams(mark: str, c: Column) -> Column:
        padded = F.concat(F.lit("^"), c, F.lit("$"))
        last = F.greatest(F.length(padded) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last),
                           lambda i: F.concat(F.lit(mark), F.substring(padded, i, F.lit(n))))
    return F.concat(grams("h", host), grams("p", path))


def _features(urls: DataFrame, n: int) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return (urls.withColumn("_host", host).withColumn("_path", path)
                .withColumn("_grams", ngrams(F.col("_host"), F.col("_path"), n)))


def labelled_table(spark: SparkSession, rows: Sequence[tuple[str, int]] = LABELLED_URLS) -> DataFrame:
    values = ", ".join("('{}', {}D)".format(u.replace("'", "''"), y) for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
                n: int = 3, n_features: int = 1 << 14, reg: float = 0.01, block_at: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every page.

    ``labelled`` (url, label with 1 = block) is a small table; it only ever
    trains the model, which holds ``n_features`` weights whatever the data. The model
    blocks from a score of ``block_at`` on: what it does not know stays near one half.
    """
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=n_features, binary=True)
    train = hashing.transform(_features(labelled.select("url", F.col("label").cast("double").alias("label")), n))
    kinds = train.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    rows = _features(pages.select("page_id", "url"), n)
    if kinds["lo"] is None or kinds["lo"] == kinds["hi"]:
        scored = rows.withColumn("block_score", F.lit(0.0))
    else:
        model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=50,
                                   probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y").fit(train)
        scored = (model.transform(hashing.transform(rows))
                  .withColumn("block_score", vector_to_array("_p")[1]))
    rule, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    learned = F.when(F.col("block_score") >= block_at, "block").otherwise("allow")
    return scored.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
                         rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "block_score")
