"""The classifier, the prefix trie and the filter audit."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.llm import audit, boost, trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_filter_audit"])
def test_against_sql(name, same):
    from vecloom.llm import queries

    same(queries.queries()[name], queries.oracle_sql()[name])


# ---- the trie


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((-1 if t is None else 0, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        lead = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(lead, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in ids if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((ids[0], len(p), members[p[:-1]][0] if p else None, len(ids), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trie_odd_rows(spark):
    rng = random.Random(2)
    words = [None, "", "é", "a", "b"]
    rows = []
    for c in [*range(-12, 40), 9_000_000_000]:
        for t in range(rng.choice([0, 1, 1, 3, 9])):
            rows.append((c, rng.choice([None, t, t, 3]), rng.choice([None, "user", "user"]), rng.choice(words)))
    rows += [rows[3], rows[3], (None, 1, "user", "lost"), (None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as depth", "2 as node", "'x' as parent", "'y' as key").repartition(3)
    assert trie_rows(trie.prefix_trie(df)) == brute_trie(rows)


def test_trie_of_none(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).collect() == []


def test_trie_one_conversation_and_copies(spark):
    one = [(5, t, "user", f"turn {t}") for t in range(30)]
    assert trie_rows(trie.prefix_trie(spark.createDataFrame(one, TURNS))) == brute_trie(one)
    # A third of all rows in one conversation, and many copies of another: ranges cut the first, pieces the digest of the second.
    rows = [(0, t, "user", "same") for t in range(300)] + [(5 * c, t, "user", f"{t}") for c in range(1, 600) for t in range(1)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert trie_rows(trie.prefix_trie(df)) == brute_trie(rows)


def test_trie_jobs_do_not_grow_with_shared_turns(spark):
    # op12 on check_h: each level that conversations share took jobs of its own.
    def jobs(turns):
        rows = [(c, t, "user", f"{t}") for c in (5, 10, 15) for t in range(turns)] + [(15, turns, "user", "more")]
        spark.sparkContext.setJobGroup(f"trie {turns}", "")
        got = trie_rows(trie.prefix_trie(spark.createDataFrame(rows, TURNS)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == brute_trie(rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trie {turns}"))

    assert abs(jobs(40) - jobs(12)) < 20


@pytest.mark.parametrize("block", [1, 3, 16])
def test_trie_blocks(spark, block):
    rng = random.Random(block)
    rows = [(c, t, "user", rng.choice("aab")) for c in range(-6, 24) for t in range(rng.choice([1, 2, 6, 17, 48]))]
    rows += [(c, t, "user", "same") for c in (100, 105, 110) for t in range(48)] + [(110, 48, "user", "more")]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert trie_rows(trie.prefix_trie(df, block=block)) == brute_trie(rows)


def test_places_across_tasks(spark):
    df = spark.createDataFrame([(c, t, "u", str(t)) for c in (1, 2) for t in range(500)], TURNS).repartition(7)
    got = collections.defaultdict(list)
    for r in trie.numbered(df).collect():
        got[r["conv_id"]].append(r["place"])
    assert {c: sorted(v) for c, v in got.items()} == {1: list(range(1, 501)), 2: list(range(1, 501))}


def test_pieces_and_digests(spark):
    ids = random.Random(1).sample(range(10**12), 2000)
    rows = [(7, 2, i) for i in ids] + [(7, 3, 1), (8, 2, 5), (8, 2, -4)]
    got = {(r[0], r[1]): r[2] for r in trie.digests(spark.createDataFrame(rows, "node long, depth long, conv_id long").repartition(6)).collect()}
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    assert got == {(7, 2): sha(ids), (7, 3): sha([1]), (8, 2): sha([5, -4])}


# ---- the audit


def brute_audit(docs, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    rows = collections.defaultdict(list)
    for i, t, _, source, _ in docs:
        text = t or ""
        w = WORDS.findall(text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        rows[source or ""].append((fails, i in good, i in toxic))
    for part, all_ in rows.items():
        shapley = collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = all_
            for k, f in enumerate(order):
                gone = [r for r in left if r[0][f]]
                failing = sum(r[0][f] for r in all_)
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in all_)
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                steps.append((f, ("".join(order), k + 1, len(left), len(gone), failing - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone))))
        out += [(part, *s, shapley[f]) for f, s in steps]
    return sorted(out)


def test_audit_odd_rows(spark):
    rng = random.Random(6)
    pool = [None, "", " ", "A", "a|b", *(" ".join(rng.choice(["a", "B", "ccc", "d#", "é", f"w{k}"]) for k in range(n)) for n in (3, 49, 50, 51, 80, 200)), " ".join(f"x{k}" for k in range(90)), "w" * 5000, "aA" * 3 + "é" * 40]
    docs = [(i if i % 11 else None, rng.choice(pool), None, rng.choice([None, "", "s1", "s1", "s2"]), None) for i in range(160)]
    docs += [docs[7], docs[7], (5, docs[8][1], None, "s9", 1)]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as part", "2 as kept", "'x' as state", "true as good", "3 as id").repartition(3)
    got = sorted(tuple(r) for r in audit.audit_filters(df, spark.createDataFrame(labels, LABELS)).collect())
    assert got == brute_audit(docs, labels)


def test_audit_of_none(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit_filters(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    rows = audit.audit_filters(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""}


def test_audit_shares_states(spark):
    """Every set of filters is filtered and counted once, whatever the number of orders that pass it."""
    rows = spark.createDataFrame([("p", True, False, True, False, False)], "part string, fails_X boolean, fails_Y boolean, fails_Z boolean, good boolean, toxic boolean")
    states = audit.walk(spark, rows, "XYZ").collect()
    assert sorted(r["state"] for r in states) == sorted(s for s in ["", "X", "Y", "Z", "XY", "XZ", "YZ", "XYZ"] if not set(s) & {"X", "Z"})
    assert audit.audit(rows, "XYZ").filter("removed > 0").count() == 6


# ---- the classifier


def plain_statistics(text):
    text = text or ""
    w = WORDS.findall(text)
    raw = text.encode()
    n = max(len(w), 1)
    return {
        "log_words": np.log1p(len(w)),
        "distinct_words": 1 - (len(w) - len(set(w))) / n,
        "again_next": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        "bar_chars": raw.count(b"|") / max(len(raw), 1),
        "upper_chars": sum(65 <= c < 91 for c in raw) / max(len(raw), 1),
        "longest_word": max((len(x.encode()) for x in w), default=0),
        "short_words": sum(len(x.encode()) <= 2 for x in w) / n,
        "shout_ends": sum(x.endswith("!") for x in w) / n,
        "stop_lines": sum(a[-1:] in ".?" and a != "" for a in text.split("\n")[:-1]) / max(text.count("\n"), 1),
    }


def test_statistics():
    texts = [None, "", " ", "\n\n", "a", "one Two two two! a|b\nx.\ny?\n z", "é ü" * 3, "long " * 400_000, "w" * 3_000_000, "\na.\n"]
    found = boost.statistics(pa.array(texts))
    assert found.shape == (len(texts), len(boost.STATISTICS)) and np.isfinite(found).all()
    for t, row in zip(texts, found, strict=True):
        for name, value in plain_statistics(t).items():
            assert row[boost.STATISTICS.index(name)] == pytest.approx(value, abs=1e-5), (name, (t or "")[:20])
    assert boost.statistics(pa.array([], pa.string())).shape == (0, len(boost.STATISTICS))


def test_trees_follow_their_nodes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    trees = boost.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    for row in x[:40]:
        margin = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += v[node - len(f)]
        assert trees.margin(row[None])[0] == pytest.approx(margin, abs=1e-12)
    again = boost.fit(x, y)
    assert (again.score(x) == trees.score(x)).all()


def test_fit_without_choice():
    none = boost.fit(np.zeros((0, 3), np.float32), np.zeros(0))
    assert (none.score(np.zeros((2, 3), np.float32)) == 0.5).all()
    assert (boost.fit(np.zeros((8, 3), np.float32), np.ones(8)).score(np.zeros((1, 3))) == pytest.approx(0.9))
    assert len(boost.fit(np.zeros((8, 3), np.float32), np.arange(8) % 2.0).feature) == boost.TREES  # nothing to split by


def test_classifier_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x", None, None, 1), (9001, "", "en", "s", 0), (9002, " \n", None, None, 2), (9003, "word " * 200_000, "en", "s", 1), (9003, "word " * 200_000, "en", "s", 1)], DOCS)
    marks = spark.createDataFrame([(9003, 0, 0), (9003, 1, None), (9002, None, 1), (None, 1, 1)], LABELS)
    both = docs.unionByName(odd).selectExpr("*", "1 as label", "2 as score", "'x' as id", "'y' as x")
    rows = boost.quality_scores(both, labels.unionByName(marks)).collect()
    assert len(rows) == docs.count() + 6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert boost.quality_scores(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in boost.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_classifier_learns_from_its_fold_only(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    mine = {r["doc_id"]: r["score"] for r in boost.quality_scores(docs, labels).collect()}
    assert mine == {r["doc_id"]: r["score"] for r in boost.quality_scores(docs.withColumn("lang", F.lit("x")).repartition(5), turned).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.filter(held).collect()}
    bad, good = ([mine[i] for i, q in truth.items() if q == k] for k in (0, 1))
    auc = np.mean([(b < g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.95
    few = boost.training_rows(docs, labels, sample_rows=100).count()
    assert 60 < few < 140


