"""Each operator against brute force on a small fixture with nulls, empty and long texts,
ties, repeated rows and extra columns; and on empty tables."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from wharf.llm import decontam, mixing, pii, simhash, substring_dedup
from wharf.llm.components import components
from wharf.llm.exact_dedup import drop_exact_copies, exact_dedup
from wharf.llm.license_scan import scan_licenses
from wharf.llm.quality import score_quality
from wharf.llm.substring_dedup import remove_repeats
from wharf.llm.toxicity import score_toxicity
from wharf.llm.url_filter import LABELLED_URLS, RULES, filter_urls, labelled_table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "n long, score string, kept string, words string, copies string")


def _texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ÀB", "日本"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(60)]
    passage = " ".join(rng.choices(vocab, k=40))
    out = list(base)
    out += [t.upper() for t in base[:4]] + base[:10]                             # copies, some by case only
    for t in base[10:25]:                                                     # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        out.append("  ".join(w))
    out += [f"{t}\n{passage}\t{t[:50]}" for t in base[25:40]]                  # shared passage
    out += [None, "", "", " \t\n", "a b c", "x " * 4000, " ".join(rng.choices(vocab, k=5000))]
    out += ["mail a.b+c@d.example.com, ip 10.2.300.4 or 1.22.33.255; card 4111 1111 1111 1111 no 4111111111111112",
            "call +1 (234) 555-0199 or +12 or +1234567 then a@b@c.dd.ee%x@y.zz 1.2.3.4.5.6.7.8 é+49 30 1234567890",
            "write to bob [at] corp [dot] com; phone 234-555-0199", "9" * 3000 + " " + "a" * 3000 + " @ . ",
            "Released under the MIT License.\nLicensed under CC BY-NC 4.0. GNU General-Public LICENSE", "mit license mit license"]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    made = [(i * 3, t, "en", f"s{i % 7}" if i % 11 else None, 0, i, "s", "k", "w", "c") for i, t in enumerate(texts)]
    made.append((None, "only this null document", None, None, None, None, None, None, None, None))
    return made + made[-2:-1] + made[:1]                                       # rows that repeat


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    return spark.createDataFrame([(i, int(i % 2 == 0), int(i % 5 == 0)) for i in ids] + [(None, 1, 0), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and _luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data(docs, empty, rows):
    found = pii.find_personal_data(docs).select("doc_id", pii.written("base").alias("b"), pii.written("spans").alias("s"),
                                                pii.n_of("email").alias("n")).collect()
    expected = collections.Counter((r[0], ",".join(_base(r[1]))) for r in rows)
    assert collections.Counter((r.doc_id, r.b) for r in found) == expected
    for r in found:
        assert set(r.b.split(",")) - {""} <= set(r.s.split(","))
        assert r.n == r.b.count("email")
    assert pii.find_personal_data(empty).count() == 0


def test_reliabilities_follow_agreement():
    yes, no = (pii.YES,) * 4 + (pii.NONE,), (pii.NO, pii.NO, pii.NONE, pii.NONE, pii.NO)
    odd = (pii.NO, pii.YES, pii.YES, pii.YES, pii.NONE)          # one labeler against three
    patterns = [((0, yes, 1), 900), ((0, no, 1), 900), ((0, odd, 1), 30)]
    post = pii.estimate(patterns)
    assert post[(0, yes, 1)] > 0.95 and post[(0, no, 1)] < 0.05 and post[(0, odd, 1)] > 0.5
    weights = pii.train(patterns, post)
    z = [sum(weights[i] for i in pii._inputs(p)) for p, _ in patterns]
    assert z[0] > 0 > z[1]


def test_url_filter(spark):
    urls = ["HTTP://A.Net/x", "http://example.net/en/1", "https://www.example.com/de/?q", "http://b.org/fr/#a", "http://b.org/fr",
            "no scheme", None, "", "http://net", "x://", "ftp://EXAMPLE.net/enx/", "http://bestcasino.example/win-slots", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in enumerate(urls + urls[:2])],
                                  "page_id long, url string, host string, path string, verdict string")
    got = {r.page_id: r for r in filter_urls(pages, labelled_table(spark)).collect()}
    for i, u in enumerate(urls + urls[:2]):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest).group()
            path, host = re.match("[^?#]*", rest[len(host):]).group(), host.translate(LOW)
        fits = [(len(t), t, v) for v, t in RULES for h, p in [(t[:t.index("/")], t[t.index("/"):])]
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert got[11].verdict == "block"
    train = {u: y for u, y in LABELLED_URLS}
    known = spark.createDataFrame([(i, u) for i, u in enumerate(train)], "page_id long, url string")
    right = sum((r.block_score >= 0.5) == bool(y) for r, y in
                zip(filter_urls(known, labelled_table(spark)).orderBy("page_id").collect(), train.values()))
    assert right >= 0.95 * len(train)
    # Held out: each URL judged by a model of the other three quarters.
    found = []
    for part in range(4):
        held = {u: y for u, y in train.items() if zlib.crc32(u.encode()) % 4 == part}
        rest = [(u, y) for u, y in LABELLED_URLS if u not in held]
        asked = spark.createDataFrame(list(enumerate(held)), "page_id long, url string")
        found += [(y, r.block_score >= 0.8) for r, y in
                  zip(filter_urls(asked, labelled_table(spark, rest)).orderBy("page_id").collect(), held.values())]
    blocked = [y for y, f in found if f]
    assert len(found) == len(train) and sum(blocked) >= 0.8 * len(blocked) and sum(blocked) >= 10
    one_kind = spark.createDataFrame([("http://a", 1)], "url string, label int")
    assert {r.verdict for r in filter_urls(pages, one_kind, rules=()).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), labelled_table(spark)).count() == 0


def test_labelled_hosts_are_not_the_tables(spark):
    import duckdb
    hosts = duckdb.sql("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(LABELLED_URLS) <= 200
    assert not {h for (h,) in hosts} & {u.split("://")[1].split("/")[0] for u, _ in LABELLED_URLS}


def _norm(t):
    return (t or "").translate(LOW)


def test_exact_dedup(docs, empty, rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[_norm(r[1])].append(r[0])
    got = exact_dedup(docs, hash_all=True).collect()
    by_hash = collections.defaultdict(list)
    for r in got:
        by_hash[r.full_hash].append(r)
    assert len(by_hash) == len(groups)
    for text, ids in groups.items():
        same = by_hash[hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in same)
        keep = max((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in same} == {keep} and {r.group_size for r in same} == {len(ids)}
        assert sum(r.kept for r in same) == 1 and [r.doc_id for r in same if r.kept] == [keep]
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(_norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0


def test_licenses(docs, empty, rows):
    phrases = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
    got = collections.defaultdict(list)
    for r in scan_licenses(docs).collect():
        got[r.doc_id].append(r)
    for i, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _norm(text))
        at = [(k, label) for p, label in phrases for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        for r in got[i]:
            assert (r.n_words, r.n_base) == (len(w), len(at))
            assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
            assert r.base_labels == ",".join(sorted({x for _, x in at}))
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    noticed = [r for r in got[max(k for k, v in got.items() if k is not None and "cc-by" in v[0].base_labels)]]
    assert {"mit-notice", "cc-by-nc-4.0"} <= set(noticed[0].labels.split(","))
    assert scan_licenses(empty).count() == 0


def test_license_join_is_exact(spark):
    """Labels against containment of every template in every block, by sets."""
    rng = random.Random(2)
    templates = (("t1", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("t2", "beta delta zeta lambda"),
                 ("t3", "alpha alpha nu"))
    vocab = sorted({w for _, t in templates for w in t.split()}) + ["the", "of", "and"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 200))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(docs, templates, threshold=0.75).collect():
        w = texts[r.doc_id].split()
        blocks = [set(w[i:i + 128]) for i in range(0, max(len(w), 1), 64)]
        want = {label for label, t in templates for b in blocks if len(b & set(t.split())) >= 0.75 * len(set(t.split()))}
        assert set(r.template_labels.split(",")) - {""} == want


def test_licenses_of_any_length(spark, docs):
    """Whole license texts as templates, more than a thousand of them; labels against sets of words."""
    rng = random.Random(9)
    vocab = [f"term{i}" for i in range(300)]
    templates = [(f"it's {k}", " ".join(rng.choices(vocab, k=rng.choice([5, 150, 400])))) for k in range(1100)]
    templates += [("none", " ... "), ("quoted", "Don't; 'AS IS'")]
    texts = []
    for _ in range(12):
        body = rng.choice(templates)[1].split()
        for _ in range(rng.randint(0, len(body) // 8)):
            body[rng.randrange(len(body))] = "changed"
        texts.append(" ".join(["before"] * rng.randint(0, 700) + body + ["after"] * 90))
    mine = spark.createDataFrame(list(enumerate(texts + ["it is don t as is", None])), "doc_id long, text string")
    step = max(len(t.split()) for _, t in templates)
    assert step == 400
    for r in scan_licenses(mine, templates).collect():
        w = (texts + ["it is don t as is", ""])[r.doc_id].split()
        blocks = [set(w[i:i + 2 * step]) for i in range(0, max(len(w), 1), step)]
        sets = {label: set(re.findall("[a-z0-9]+", t.lower())) for label, t in templates}
        want = {label for label, t in sets.items() for b in blocks if t and len(b & t) >= 0.9 * len(t) - 1e-9}
        assert set(r.template_labels.split(",")) - {""} == want and ("quoted" in want) == (r.doc_id == 12)
    assert {r.template_labels for r in scan_licenses(docs, []).collect()} == {""}


def test_toxicity_scores(spark, docs, labels, empty):
    out = score_toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)
    assert score_toxicity(empty, labels).count() == 0
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}


def test_classifiers_learn(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("aeioulmnrst", k=6)) for _ in range(300)]
    rows, marks = [], []
    for i in range(500):
        toxic, poor = i % 4 == 0, i % 3 == 0
        w = rng.choices(words, k=60)
        if toxic:
            w[rng.randrange(60)] = "zugwurst"
        rows.append((i, " ".join(x + "###" if poor else x for x in w)))
        marks.append((i, int(not poor), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = [r for r in score_toxicity(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)
    graded = [r for r in score_quality(docs, labels).collect() if r.held_out]
    assert sum(r.kept == (r.doc_id % 3 != 0) for r in graded) >= 0.9 * len(graded)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in graded)


def test_ratios_against_counts(spark):
    """Log-count ratios against a count over all pairs of feature and text."""
    from wharf.llm import toxicity
    from wharf.llm.hashed_text import Hasher
    rng = random.Random(11)
    made = [(i % 3 == 0, " ".join(rng.choices(["vile", "nice", "word", "Été", "x"], k=rng.randint(0, 9)))) for i in range(40)]
    sample = spark.createDataFrame([(int(y), t) for y, t in made], "y int, text string").repartition(3)
    ratio, rows = toxicity.log_count_ratios(sample, least=0.0)
    hasher = Hasher(toxicity.ORDERS, toxicity.BITS)
    held = [set(hasher.present(t).tolist()) for _, t in made]
    n = [sum(not y for y, _ in made), sum(y for y, _ in made)]
    assert rows.tolist() == n
    for i in set().union(*held):
        seen = [sum(i in h and y == c for h, (y, _) in zip(held, made)) for c in (0, 1)]
        soft = [toxicity.SMOOTH * n[c] / len(made) for c in (0, 1)]
        assert ratio[i] == pytest.approx(np.log((seen[1] + soft[1]) / n[1] / ((seen[0] + soft[0]) / n[0])))
    assert np.count_nonzero(ratio) <= len(set().union(*held))


def test_ordinal_fit_is_stationary():
    """At the fit the numerical gradient of the likelihood vanishes and thresholds are ordered."""
    from wharf.llm.quality import fit_ordinal
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3))
    y = np.digitize(x @ np.array([1.0, -2.0, 0.5]) + rng.logistic(size=300), [-1.0, 1.5])
    row, col = np.repeat(np.arange(300), 3), np.tile(np.arange(3), 300)
    l2 = 1e-3
    w, theta = fit_ordinal(y, row, col, x.ravel(), 3, 3, l2=l2, rounds=2000)

    def loss(p):
        z, bounds = x @ p[:3], np.concatenate([[-np.inf], p[3:], [np.inf]])
        cdf = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
        return -np.log(cdf(bounds[y + 1] - z) - cdf(bounds[y] - z)).mean() + l2 / 2 * (p[:3] ** 2).sum()

    p, h = np.concatenate([w, theta]), 1e-5
    slope = [(loss(p + h * e) - loss(p - h * e)) / (2 * h) for e in np.eye(5)]
    assert theta[0] < theta[1] and np.abs(slope).max() < 2e-3
    assert w == pytest.approx([1.0, -2.0, 0.5], abs=0.6)


def test_sample_is_bounded_by_rows(spark):
    """Many rows of one id count once."""
    from wharf.llm.hashed_text import labelled_sample
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, "other") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    from pyspark.sql import functions as F
    got = labelled_sample(docs, labels, F.col("toxic"), 10).collect()
    assert len(got) == 10
    assert len(labelled_sample(docs.where("doc_id < 3"), labels, F.col("toxic"), 100).collect()) <= 2


def test_many_matches_in_one_text(spark):
    """Spans over several blocks, against a plain search; time in proportion to their number."""
    import time
    line = "host 10.1.2.3 and\u00e9 é 192.168.0.77, mail a@b.org; "
    took = []
    for n in (2000, 16000):
        text = line * n
        table = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.time()
        got = pii.find_personal_data(table).first()
        took.append(time.time() - begun)
        want = [(KIND, m.start(), m.end()) for KIND, rx in ((0, r"a@b\.org"), (1, r"[0-9]+(?:\.[0-9]+){3}"))
                for m in re.finditer(rx, text)]
        assert [tuple(s) for s in got.base] == want
    assert took[1] < 30 * took[0]                              # 64 times if it were the square


def test_quality_edges(docs, labels, empty):
    assert score_quality(docs, labels).count() == docs.count()
    assert score_quality(empty, labels).count() == 0
    assert {r.expected_grade for r in score_quality(docs, labels.limit(0)).collect()} == {0.0}


def _greedy(p, t, least):
    """Greedy string tiling by trying every pair of places."""
    mp, mt, covered = [False] * len(p), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(t)):
            for i in range(len(p)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        for x in range(n):
            mp[i + x] = mt[j + x] = True
        covered += n


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        p = np.array(rng.choices(range(1, 5), k=rng.randint(0, 24)), np.uint64)
        t = np.array(rng.choices(range(0, 5), k=rng.randint(0, 40)), np.uint64)
        assert decontam.tile(p, t, 3) == _greedy(list(p), [x if x else -1 for x in t.tolist()], 3)


def test_decontamination(spark, docs, empty):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    w = item.split()
    bench = spark.createDataFrame([(1, item, 0), (2, "too short", 0), (3, None, 0), (4, item.upper(), 0)],
                                  "item_id long, text string, coverage int")
    texts = [(1, "x " + item + " y"), (2, "x " + " ".join(w[7:]) + " z " + " ".join(w[:7])), (3, "x " + " ".join(w[:5]) + " q"),
             (4, " ".join(reversed(w))), (5, None), (6, item.replace(" ", ", "))]
    mine = spark.createDataFrame(texts + texts[:1], "doc_id long, text string")
    want = {(d, i): c for d, c in ((1, 14), (2, 14), (6, 14)) for i in (1, 4)}
    got = decontam.find_contaminated(mine, bench).collect()
    assert {(r.doc_id, r.item_id): r.covered_words for r in got} == want and len(got) == 8
    split = decontam.find_contaminated(mine, bench, shard_words=10).collect()  # many shards, same rows
    assert sorted(map(tuple, split)) == sorted(map(tuple, got))
    assert [r.doc_id for r in decontam.drop_contaminated(mine, bench).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontam.find_contaminated(empty, bench).count() == 0
    assert decontam.find_contaminated(mine, bench.limit(0)).count() == 0


def test_contamination_against_brute_force(spark):
    """Random documents with pieces of items: coverage by tiling every item against every document."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 30)))) for i in range(25)]
    items += [(100 + i, f"what is the value of item{i} now") for i in range(20)]    # one seed in many items
    docs = []
    for d in range(40):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 20))) for _ in range(3)]
        for _ in range(3):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts.insert(rng.randrange(len(parts)), " ".join(w[a:a + rng.randint(4, 20)]))
        docs.append((d, " ".join(parts)))
    mine, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in docs:
        for i, item in items:
            covered = _greedy(item.split(), text.split(), decontam.SEED)
            if covered and covered >= 0.5 * len(item.split()):
                want.add((d, i, covered, len(item.split())))
    for shard_words in (decontam.SHARD_WORDS, 60):
        got = decontam.find_contaminated(mine, bench, shard_words=shard_words).collect()
        assert len(got) == len(want) > 30
        assert {(r.doc_id, r.item_id, r.covered_words, r.item_words) for r in got} == want
        kept = decontam.drop_contaminated(mine, bench, shard_words=shard_words).collect()
        assert sorted(r.doc_id for r in kept) == sorted({d for d, _ in docs} - {w[0] for w in want})


def test_seed_of_many_items_is_tiled_once(monkeypatch):
    """8,000 items that share one seed: one tiling a document; unlike items are left out before any."""
    calls, tile = [], decontam.tile
    monkeypatch.setattr(decontam, "tile", lambda *a: calls.append(1) or tile(*a))
    shard = decontam.Shard([(i, f"what is the value of item{i} now") for i in range(8000)]
                           + [(-i, "what is the value of " + " ".join(f"x{i}y{j}" for j in range(6))) for i in range(1, 2000)], 5)
    found = list(shard.matches("so what is the value of that", 0.5))
    assert len(found) == 8000 and {f[1:] for f in found} == {(5, 7)} and len(calls) == 1


@pytest.mark.parametrize("text", ["слово и дело " * 100, "λόγος " * 300, "漢字" * 1200, "क्या है " * 150, "plain words " * 150])
def test_shards_in_any_alphabet(spark, text):
    """The words and characters of a shard are bounded whatever the alphabet."""
    items = spark.createDataFrame([(i, f"{text} {i}") for i in range(40)], "item_id long, text string")
    dealt, shards = decontam._shards(items, 1000)
    assert shards >= 12
    held = collections.Counter(r.shard for r in dealt.collect())
    assert max(held.values()) <= 12 and sum(held.values()) == 40


def test_substring_dedup(docs, empty, rows, monkeypatch):
    first = {}
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    want = []
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        cut = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                cut[k:k + 13] = [True] * 13
        left = b" ".join(x for x, c in zip(w, cut) if not c)
        want.append((str(i), len(w), sum(cut), hashlib.sha256(left).hexdigest()))
    used, look = [], substring_dedup._candidates
    monkeypatch.setattr(substring_dedup, "_candidates", lambda r, f, parts: used.append(parts) or look(r, f, parts))
    for seeds, held in ((1 << 25, 8), (200, 1000), (1, 1)):                  # one bitmap, some, the join
        monkeypatch.setattr(substring_dedup, "SHARD_SEEDS", seeds)
        monkeypatch.setattr(substring_dedup, "MAX_SHARDS", held)
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs).collect()]
        assert sorted(got) == sorted(want) and sum(x[2] > 0 for x in got) > 20
    assert len(used[0]) == 1 < len(used[1]) and used[2] is None
    assert remove_repeats(empty).count() == 0


def _fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        rest, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > 2 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / w for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            open_.remove(s)


def test_mixing(docs, empty, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    target = _fill(sizes)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.05 * t, max(r.size for r in out if r.source == s) / 2)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copies"] + ["copies", "target"]
    assert sum(r.copies * len((r.text or "").encode().split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_deals_repeated_ids(spark, monkeypatch):
    """Rows of one source with null or equal doc_ids are dealt to groups like any others."""
    monkeypatch.setattr(mixing, "GROUP", 50)
    sizes = []
    monkeypatch.setattr(mixing, "materialize", lambda df, name="t", real=mixing.materialize: (
        sizes.extend(r[0] for r in df.groupBy("source_no", "bucket").count().select("count").collect())
        if name == "mix-level" else None, real(df, name))[1])
    made = [(None if i % 2 else 7, "a", " ".join(["w"] * (1 + i % 9) + [f"t{i % 300}"])) for i in range(2000)]
    docs = spark.createDataFrame(made + [(i, "b", "b " * 3) for i in range(400)], "doc_id long, source string, text string")
    out = mixing.mix(docs).collect()
    assert len(out) == 2400 and sizes and max(sizes) <= 100
    key = lambda r: (str(r.doc_id), r.source, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()))


def test_pivotal_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    size, p = np.array([5, 9, 2, 7, 30]), np.array([0.3, 0.5, 0.9, 0.2, 0.4])
    runs = [mixing.pivotal(size, p, rng.random(5)) for _ in range(4000)]
    for q, left in runs:
        assert (size * q).sum() == pytest.approx((size * p).sum())
        assert sum(0 < x < 1 for x in q) <= 1
    assert np.mean([q for q, _ in runs], axis=0) == pytest.approx(p, abs=0.03)


def _fp(text):
    w = _norm(text).encode().split()
    sh = [b" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(pairs, n):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_simhash(docs, empty, rows, group, monkeypatch):
    monkeypatch.setattr(simhash.links_of, "__defaults__", (simhash.DISTANCE, simhash.BLOCKS, group))
    fps = [_fp(r[1]) for r in rows]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    classes = _classes(pairs, len(fps))
    smallest = {}
    for r, c in zip(rows, classes):
        if r[0] is not None:
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexed().alias("f"), "component_id").collect()
    want = collections.Counter((r[0], f"{f:016x}", smallest.get(c)) for r, f, c in zip(rows, fps, classes))
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [20_000, 8])
def test_links_of_dense_clusters(spark, group):
    """Many fingerprints around few centres, also beyond a group's bound."""
    rng = random.Random(6)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.choices(range(64), k=rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = _classes(pairs, len(fps))
    links = simhash.links_of(spark.createDataFrame([(s,) for s in signed], "fp long"), group=group)
    root = {r.node: r.root for r in components(links).collect()}
    got = [root.get(s, s) for s in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_one_near_copy_stays(spark):
    """Also where doc_ids are null or repeat inside and across components."""
    made, part = [], {}
    for c, ids in enumerate([[5, 5, 7], [3, 5, None], [None, None], [None, 4, 4], [5], [None]]):
        w = [f"c{c}w{k}" for k in range(4000)]
        for i in ids:
            w[3999] = f"e{len(made)}"
            made.append((i, " ".join(w)))
            part[made[-1][1]] = c
    made.append(made[0])
    left = simhash.drop_near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    assert sorted((part[r.text], r.doc_id) for r in left if part[r.text] not in (2, 5)) == [(0, 5), (1, 3), (3, 4), (4, 5)]
    assert [r.doc_id for r in left if part[r.text] in (2, 5)] == [None, None] and len(left) == 6


def test_pipeline(spark, rows, tmp_path):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    item = rows[30][1]
    ids = [r[0] for r in rows if r[0] is not None]
    for sub, table in (("full", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / sub / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / sub / "labels.parquet"))
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / sub / "benchmark.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path / "full"))
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        after.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
    left = before.collect()
    assert len({_norm(r.text) for r in left}) == len(left) and not any(item in (r.text or "") for r in left)
    fps = [_fp(r.text) for r in left]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).columns == [*docs.columns, "copies", "target"]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
