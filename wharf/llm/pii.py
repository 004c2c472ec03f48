"""Personal data by weak supervision: regex, gazetteer and context labelers
vote on candidate spans; expectation-maximisation estimates how far each can be
relied on, and its posteriors train the classifier that decides on the spans.

Candidates are the base matches (which always stay) and looser forms: written
out e-mail addresses, phone numbers without a country code, and digit groups
that fail the base checks. The votes of all candidates of all documents are
counted per pattern (kind, five votes, length class: at most 4 * 3^5 * 3 rows);
those counts are all that the estimation needs and all that reaches the driver.

Regexes are written so that no text makes them slow: runs are possessive and
start where a run can start (or where the last match ended), which leaves the
leftmost matches as they are. Offsets are code points, summed from the pieces
between the matches.

Defined results: null or empty text has no spans (the hash is that of the empty
text); repeated rows each give their own row; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.llm.common import text_of
from wharf.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Matches of a text whose starts are summed at a time.
BLOCK = 256

_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms.
_EMAIL_OUT = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+"
              r"(?:(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,8}+")
_PHONE_OUT = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"

# Octets, top-level domains, issuer digits, dial codes and context words.
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_TLDS = r"(?i)[.\x20)\]](?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ch|at|nl|be)$"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_PRIVATE_NETS = r"^(?:0|10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
_DIAL_CODES = r"^\+(?:1|7|20|27|3[0-46-9]|4[0-1346-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_FOR = {"email": r"e-?mail|contact|write to|correo|courriel", "ip": r"\bip\b|address|server|host",
        "card": r"card|visa|amex|credit|tarjeta|carte|karte", "phone": r"phone|\btel\b|call|mobile|fax|\bfon"}
_AGAINST = r"version|\bv\.?$|order|invoice|isbn|serial|token|commit|build|part no|\bid\b|[=#]\s*$"

_SPAN = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:array<int>,size:int>>"
YES, NO, NONE = 1, 2, 0
_LABELERS = ("regex", "structure", "gazetteer", "context for", "context against")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of up to 19 digits."""
    padded = F.lpad(digits, 19, "0")
    # The doubled places count 2d, less 9 above 9.
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = sum((F.substring(doubled if i % 2 == 0 else padded, i, 1).cast("int") for i in range(1, 20)),
                F.lit(0))
    return total % 10 == 0


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the element of a one-element array."""
    return F.transform(F.array(value), use)[0]


def find(text: Column, regex: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, match, before).

    Starts are sums of the lengths before, taken in blocks: an array that grows match by
    match would be copied each time, which costs the square of their number.
    """
    spans = "array<struct<start:int,stop:int,m:string,before:string>>"
    empty = F.coalesce(F.lit(None).cast(spans), F.array().cast(spans))
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(regex), 0).alias("m"),
                          F.split(text, regex, -1).alias("p"))
    found = F.filter(zipped, lambda x: x["m"].isNotNull())

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("m"),
                       F.substring(x["p"], -32, 32).alias("before"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def walk(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def in_blocks(blocks):
        sizes = F.transform(blocks, lambda b: F.aggregate(
            b, F.lit(0), lambda n, x: n + F.length(x["p"]) + F.length(x["m"])))
        none = F.array().cast("array<int>")
        starts = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.coalesce(F.lit(None).cast("array<int>"), none).alias("out")),
                             lambda acc, n: F.struct((acc["at"] + n).alias("at"),
                                                     F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                             lambda acc: acc["out"])
        return _once(starts, lambda s: F.flatten(F.transform(blocks, lambda b, i: walk(b, F.get(s, i)))))

    def split(all_found):
        last = F.floor((F.size(all_found) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_found, i * BLOCK + 1, F.lit(BLOCK)))
        return _once(blocks, in_blocks)

    return F.when(text.rlike(regex), _once(found, split)).otherwise(empty)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(NONE)


def _voted(kind: str, spans: Column, base, structure, gazetteer) -> Column:
    """Candidates with their votes; ``base``... take (match, digits)."""
    def one(x):
        m, d, before = x["m"], _digits(x["m"]), F.lower(x["before"])
        is_base, holds, listed = base(m, d), structure(m, d), gazetteer(m, d)
        votes = F.array(F.when(is_base, YES).otherwise(NO), _vote(holds, ~holds), _vote(listed, F.lit(False)),
                        _vote(before.rlike(_FOR[kind]), F.lit(False)), _vote(F.lit(False), before.rlike(_AGAINST)))
        size = F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).otherwise(2)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"),
                        is_base.alias("base"), votes.alias("votes"), size.alias("size"))
    return F.transform(spans, one).cast(_SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of a text; looser ones only where no base span of the kind lies."""
    never = lambda m, d: F.lit(False)
    octets = lambda m, d: m.rlike(_OCTETS)
    card = lambda m, d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    phone = lambda m, d: F.length(d).between(8, 15)
    tld = lambda m, d: m.rlike(_TLDS)
    dial = lambda m, d: m.rlike(_DIAL_CODES)
    parts = (
        _voted("email", find(text, _EMAIL), lambda m, d: F.lit(True), tld, tld),
        _voted("email", find(text, _EMAIL_OUT), never, tld, tld),
        _voted("ip", find(text, _IP), octets, octets, lambda m, d: ~m.rlike(_PRIVATE_NETS)),
        _voted("card", F.filter(find(text, _CARD), lambda x: F.length(_digits(x["m"])).between(13, 19)),
               lambda m, d: (F.length(d) >= 16) & card(m, d), card, lambda m, d: d.rlike(_ISSUERS)),
        _voted("phone", find(text, _PHONE), phone, phone, dial),
        _voted("phone", find(text, _PHONE_OUT), never, phone, dial),
    )
    return F.concat(*parts)


def estimate(patterns: list[tuple], rounds: int = 30) -> dict[tuple, float]:
    """Expectation-maximisation over vote patterns (kind, votes, ...) with counts:
    probability that a pattern's spans are personal data."""
    k = len(_LABELERS)
    post = {}
    for p, _ in patterns:
        yes, no = p[1].count(YES), p[1].count(NO)
        post[p] = (yes + 1) / (yes + no + 2)
    for _ in range(rounds):
        # P(vote | class) per labeler and a prior per kind, with one added count each.
        like = [[[1.0] * 3 for _ in range(2)] for _ in range(k)]
        prior = [[1.0, 1.0] for _ in KINDS]
        for p, n in patterns:
            for c, weight in ((1, n * post[p]), (0, n * (1 - post[p]))):
                prior[p[0]][c] += weight
                for j, v in enumerate(p[1]):
                    like[j][c][v] += weight
        for p, _ in patterns:
            log = [0.0, 0.0]
            for c in (0, 1):
                log[c] = math.log(prior[p[0]][c] / sum(prior[p[0]]))
                log[c] += sum(math.log(like[j][c][v] / sum(like[j][c])) for j, v in enumerate(p[1]))
            post[p] = 1 / (1 + math.exp(max(-700, min(700, log[0] - log[1]))))
    return post


def _inputs(p: tuple) -> list[int]:
    """Features that are 1 for a pattern: kind, each labeler's vote, length class."""
    return [p[0], *(4 + 3 * j + v for j, v in enumerate(p[1])), 4 + 3 * len(_LABELERS) + p[2]]


def train(patterns: list[tuple], post: dict[tuple, float], rounds: int = 300, l2: float = 1e-3) -> list[float]:
    """Logistic regression on the posteriors, each pattern weighed by its count."""
    weights = [0.0] * (4 + 3 * len(_LABELERS) + 3)
    total = sum(n for _, n in patterns) or 1
    for _ in range(rounds):
        slope = [l2 * w for w in weights]
        for p, n in patterns:
            z = sum(weights[i] for i in _inputs(p))
            off = (1 / (1 + math.exp(-max(-30, min(30, z)))) - post[p]) * n / total
            for i in _inputs(p):
                slope[i] += off
        weights = [w - 1.0 * s for w, s in zip(weights, slope)]
    return weights


def _score(weights: list[float]) -> callable:
    w = F.array(*[F.lit(float(x)) for x in weights])

    def of(x):
        z = F.get(w, x["kind"]) + F.get(w, x["size"] + (4 + 3 * len(_LABELERS)))
        for j in range(len(_LABELERS)):
            z = z + F.get(w, F.get(x["votes"], F.lit(j)) + (4 + 3 * j))
        return 1 / (1 + F.exp(-z))
    return of


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, base (spans), spans (base and added), each an
    array of (kind, start, stop) by kind, then start."""
    rows = materialize(docs.select("doc_id", candidates(text_of()).alias("_c")), "pii-candidates")
    counted = (rows.select(F.explode("_c").alias("x"))
               .groupBy("x.kind", "x.votes", "x.size").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = sorted(((r["kind"], tuple(r["votes"]), r["size"]), r["n"]) for r in counted)
    score = _score(train(patterns, estimate(patterns)))

    short = "array<struct<kind:int,start:int,stop:int>>"
    thin = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    base = F.transform(F.filter("_c", lambda x: x["base"]), thin).cast(short)
    free = lambda x: ~F.exists("base", lambda b: (b["kind"] == x["kind"])
                               & (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    added = F.filter("_c", lambda x: ~x["base"] & (score(x) >= threshold) & free(x))
    return (rows.withColumn("base", F.array_sort(base))
                .select("doc_id", "base", F.array_sort(F.concat("base", F.transform(added, thin).cast(short)))
                        .alias("spans")))


def written(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def n_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
