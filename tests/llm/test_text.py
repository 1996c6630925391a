"""Operators on texts, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from vecloom.llm import bpe, encode, jaccard, lm, mixing, quality, sharding
from vecloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "a", "a b\n\n a b\r\n", "x\ny", "one two three four", "One TWO three four", "é ü ß", "a b  c　 d", "<|endoftext|> a<|endoftext|>", "the same line\n" * 40, "w " * 300, "z" * 4000, "don't  we'll I'M\t\tx\x1fy"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and an extra column that clashes with inner names."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = list(ODD)
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            changed = list(words)
            for _ in range(rng.randint(0, 8)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[21], "en", "s1", 3), (None, None, None, None, None), (17, texts[25], "de", "s2", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id as id", "1 as n", "'x' as bucket", "0 as copies", "'q' as row")
    return rows, df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd[1].filter("doc_id < -1")


def base_metrics(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    dup = len(lines) - len(set(lines))
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}
    for n in quality.COVERAGE:
        known, chars = set(), set()
        for i in range(len(w) - n + 1):
            gram = tuple(w[i : i + n])
            if gram in known:
                chars |= set(range(i, i + n))
            known.add(gram)
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in chars)
    return out


def test_quality(odd, none, spark, sf_dir):
    for df in (odd[1], spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
        got = quality.score_quality(df).collect()
        assert len(got) == sum(texts.values())
        want = collections.Counter()
        for (i, t), n in texts.items():
            m = base_metrics(t)
            failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
            want[(i, *m.values(), failed)] += n
        names = list(base_metrics(""))
        assert collections.Counter((r["doc_id"], *(r[k] for k in names), r["base_failed"]) for r in got) == want
        assert all(not r["kept"] for r in got if r["base_failed"])
    kept = quality.keep_quality(odd[1])
    assert kept.columns == odd[1].columns
    assert kept.count() == quality.score_quality(odd[1]).filter("kept").count()
    assert quality.score_quality(none).count() == quality.keep_quality(none).count() == 0
    once, line = " ".join(f"w{i}" for i in range(60)), " ".join(f"line{i}" for i in range(40))
    m = quality.metrics(pa.array([once, (once + " ") * 2, f"{once} {once.upper()}\n{line}\nx\n{line}", f"{once} {once.upper()} {line} {line}", f"{once}\n\n{once.upper()}\nx y\nz\nx y"]))
    assert quality.accepted(m).tolist() == [True, False, False, False, True]  # a repeated line counts with line breaks and without
    assert m["dup_chars_10"][2] == m["dup_chars_10"][3] > 0


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in g]
    return collections.Counter(out)


SMALL = {"bucket_entries": 300, "block_rows": 2, "block_entries": 400, "bin_entries": 300}


@pytest.mark.parametrize("sizes", [{}, SMALL, SMALL | {"joins": "shuffle"}])
def test_jaccard(odd, sizes, spark, monkeypatch):
    rows, df = odd
    sizes = dict(sizes)
    if sizes.pop("joins", ""):  # as where tables are too large to be broadcast
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(df, **sizes).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == components_of(rows)


@pytest.mark.parametrize("sizes", [{}, SMALL | {"block_rows": 64, "block_entries": 9000, "bin_entries": 4000}])
def test_jaccard_hot_group(spark, sizes):
    """Changed copies of one text, from near to far, so that components stay apart behind the seeds and meet in long lists,
    beside texts that share a passage with all of them."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        changed = list(words)
        for _ in range(rng.randint(0, 5)):
            changed[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(changed)))
    rows += [(1000 + i, " ".join(words[:40] + [f"y{i}_{k}" for k in range(20)])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collections.Counter(tuple(r) for r in jaccard.jaccard_components(df, **sizes).collect()) == components_of(rows)


def test_keep_one(odd):
    """One row of every group, with null and repeated ids and rows alike in every column."""
    rows, df = odd
    want = {r[2] for r in components_of(rows) if r[1]}
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    worded = collections.Counter(r["doc_id"] for r in got if WORDS.search(r["text"] or ""))
    assert set(worded) == want and set(worded.values()) == {1}
    assert sum(not WORDS.search(r["text"] or "") for r in got) == sum(not WORDS.search(r[1] or "") for r in rows)


def test_jaccard_on_data(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert collections.Counter(tuple(r) for r in jaccard.jaccard_components(df).collect()) == components_of([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_jaccard_borders(spark, none):
    words = [f"w{i}" for i in range(100)]
    a = " ".join(words[:32])  # 28 shingles; cutting 7 leaves 21 of 28, exactly three quarters
    rows = [(5, a), (3, " ".join(words[:25])), (9, " ".join(words[:24])), (1, "x y"), (2, "X  y"), (4, "y x")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 4: 4}
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert jaccard.jaccard_components(none).count() == 0
    assert jaccard.keep_one(none).count() == 0


def test_divide_skip():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = sorted((np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)), key=len)
    sets += [sets[40], sets[41][:-1]]
    sets.sort(key=len)
    postings = jaccard.Postings(sets)
    for i, s in enumerate(sets):
        both = [len(np.intersect1d(s, t)) for t in sets]
        want = [j for j, t in enumerate(sets) if j != i and 100 * both[j] >= 75 * (len(s) + len(t) - both[j])]
        assert sorted(postings.linked(i)) == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randint(1000, 1100)) for _ in range(50)] + [(1, 2), (2, 1), (3, 3), (None, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and got[7] == 7 and got[2] == 1 and 3 not in got and 4 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(odd, none, spark, sf_dir, same):
    from vecloom.llm import queries

    same(queries.op4_source_mixing, mixing.ORACLE_SQL)
    rows, df = odd
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    totals = collections.Counter()
    for r in rows:
        totals[r[3]] += len(WORDS.findall(r[1] or ""))
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    targets, open_, left = {}, set(order), sum(totals.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * totals[s]}
        for s in full or open_:
            targets[s] = 3 * totals[s] if full else weight[s] * level
        left -= sum(3 * totals[s] for s in full)
        open_ = open_ - full if full else set()
    by_size = {totals[s]: targets[s] for s in order}
    for r in got:
        assert r["target"] == pytest.approx(by_size[r["source_size"]]) and 0 <= r["taken"] <= 3 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(df).collect()))
    mixed = mixing.mix_rows(df)
    assert mixed.columns == df.columns
    copies = collections.Counter()
    for r in got:
        if r["copies"]:
            copies[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == copies
    assert mixing.mix_report(none).count() == mixing.mix_rows(none).count() == 0


def test_pipeline_stages_on_odd_rows(odd, none, spark, tmp_path):
    """Each stage on what its predecessor kept, with nulls, repeated rows and columns of clashing names; and on no rows."""
    import hashlib

    pipeline = pytest.importorskip("corpus_pipeline")
    for first in (odd[1], none):
        docs, before = first, None
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < 3:
                assert out.columns == first.columns
            path = f"{tmp_path}/{first is none}-{k}"
            out.write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
        want = collections.Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in before.collect())
        assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in docs.collect()) == want
        assert bool(want) == (first is not none)


def test_mix_nears_targets(spark, sf_dir):
    sums = collections.Counter()
    goal = {}
    for r in mixing.mix_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        sums[r["target"], r["source_size"]] += r["taken"]
        goal[r["target"], r["source_size"]] = r["target"]
    assert sum(abs(sums[k] - goal[k]) for k in goal) < 0.05 * sum(goal.values())


def test_sharding(odd, none, same):
    from vecloom.llm import queries

    same(queries.op1_extendible_sharding, sharding.ORACLE_SQL)
    rows, df = odd
    got = sharding.extendible_shards(df, 20_000).collect()
    assert len(got) == len(rows)
    sums = collections.Counter()
    for r in got:
        sums[r["shard"], r["page"], r["shard_bytes"]] += r["n_bytes"]
    assert all(n == size for (_, _, size), n in sums.items())
    assert all(r["oversized"] or r["shard_bytes"] <= 20_000 for r in got)
    for r in got:  # only buckets over the limit are split
        if r["depth"] and r["depth"] < 60:
            assert sum(n for (s, _, _), n in sums.items() if s.startswith(r["shard"][:-1])) > 20_000
    assert sharding.extendible_shards(none).count() == 0


def test_overflow_pages(spark):
    df = spark.createDataFrame([(7, "x" * 40)] * 30 + [(8, "y" * 200), (9, "")], "doc_id long, text string").repartition(4)
    got = sharding.extendible_shards(df, 100).collect()
    assert len(got) == 32
    pages = collections.Counter((r["shard"], r["page"]) for r in got if r["doc_id"] == 7)
    assert len(pages) == 15 and set(pages.values()) == {2}
    assert [r["oversized"] for r in got if r["doc_id"] == 8] == [True]


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


def test_bpe(odd, none, public):
    import tiktoken

    rows, df = odd
    path = public.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=encode.read_ranks(path), special_tokens={})
    want = collections.Counter()
    for r in rows:
        ids = coder.encode_ordinary(r[1] or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.round_trip(df, path, public.PATTERN).collect()) == want
    assert bpe.round_trip(none, path, public.PATTERN).count() == 0
    assert bpe.encode_column(df, path, public.PATTERN).filter("length(ids) != 4 * n_tokens").count() == 0


def test_pieces(public):
    """Random mixtures of the bytes that borders of pieces depend on."""
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(9)
    alphabet = list(" \n\t\r 　ab'sdé1٣!.,-😀\x1f\x85  ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["ab" * 5000, " " * 3000]
    ranks = encode.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for cache, whole in ((encode.PieceCache(encode.rank_encoder(ranks, public.PATTERN), most=50), coder.encode_ordinary), (encode.PieceCache(*encode.library_encoder(public.path("byte_bpe_50k.json"))), lambda t: library.encode(t, add_special_tokens=False).ids)):
        got = []
        for ids, bounds in encode.encode_texts(pa.array(texts), cache):
            got += [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [whole(t) for t in texts]


def test_long_pieces(public):
    """One pre-token of a megabyte, and shorter ones by ranks in random order, where merges make pairs of lower rank."""
    import time

    from tokenizers import Tokenizer

    ranks = encode.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    library, ours = Tokenizer.from_file(public.path("byte_bpe_50k.json")), encode.rank_encoder(ranks, public.PATTERN)
    rng = random.Random(2)
    for text in ("z" * 1_000_000, "ab" * 500_000, "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "".join(rng.choice("ab") for _ in range(300_000))):
        began = time.process_time()
        ids, _ = ours([text.encode()])
        assert time.process_time() - began < 30
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids

    def slow(raw, ranks):
        parts = [bytes([b]) for b in raw]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(60):
        tokens = {bytes(x) for n in range(2, 7) for x in (rng.choices(b"abc", k=n) for _ in range(12))}
        order = list(tokens)
        rng.shuffle(order)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        texts = [bytes(rng.choices(b"abc", k=rng.randint(0, 80))) for _ in range(30)]
        ids, bounds = encode.RankBpe(ranks).encode(texts)
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)] == [slow(t, ranks) for t in texts]


def test_rank_queue():
    import numpy as np

    queue, rng = encode.RankQueue(60_000), random.Random(3)
    pushed = collections.Counter()
    for _ in range(500):
        r = rng.randrange(60_000)
        pushed[r] += 1
        queue.push(r, np.array([r]))
    out = []
    while (entry := queue.pop()) is not None:
        out.append((entry[0], len(entry[1])))
    assert out == sorted(pushed.items())


def test_lm(odd, none, public):
    rows, df = odd
    got = lm.score_texts(df, public.path("byte_bpe_50k.json"), frequent=40).collect()
    words = [[*WORDS.findall((r[1] or "").translate(LOWER)), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = collections.Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for r, ws, h in zip(rows, words, held, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_texts(none, public.path("byte_bpe_50k.json")).count() == 0


def test_training_covers_texts(spark, public):
    """Each subword and each end of the training texts is a target of exactly one window, and held-out texts of none."""
    import numpy as np

    from vecloom.llm import attention as A

    path = public.path("byte_bpe_50k.json")
    texts = ["some words and others " * 300, "short", "", None, "held out " * 50, "end here " * 24]
    rows = spark.createDataFrame([(t, i == 4, 1000 * i) for i, t in enumerate(texts)], "text string, held_out boolean, mark long")
    cache, size = lm._coder(path)
    want = collections.Counter()
    for i, t in enumerate(texts):
        for *_, ids, _ in lm._texts(pa.array([t]), cache, size - 1):
            want.update(ids.tolist() if i != 4 else [])
    got = collections.Counter()
    shards = collections.defaultdict(list)
    for r in lm.gather(rows, path, 0, 3).filter("kind = 2").collect():
        shards[r["bucket"]].append(np.frombuffer(r["packed"], "<u2"))
    assert len(shards) > 1
    for parts in shards.values():
        before, target = lm.training_windows(np.concatenate(parts).astype(np.int64), size - 1)
        assert before.shape[1] == A.CONTEXT
        got.update(target[target >= 0].tolist())
    assert got == want
    assert A.CONTEXT >= 32 and A.CONTEXT - A.STRIDE >= 16


def test_lm_learns(spark, public, monkeypatch):
    """Held-out texts are likelier than by word counts; the partitions of the rows don't matter, with several shards."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 6 << 20)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    path = public.path("byte_bpe_50k.json")
    first = lm.score_texts(docs.repartition(3), path).collect()
    held = [r for r in first if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = {r["doc_id"]: r["score"] for r in lm.score_texts(docs.repartition(7), path).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-4, abs=1e-3) for r in first)


def test_model_stays_finite():
    """Logits that training has driven far off give small probabilities, not none."""
    import numpy as np

    from vecloom.llm import attention as A

    w = A.initial(np.log(np.full(64, 1 / 64)))
    w["bias"][:] = [-3000, -2000]
    w["bias2"][:] = -1000
    c = np.arange(20).reshape(2, 10)
    loss, grad = A.gradient(w, c, c, np.ones((2, 10), np.float32))
    assert np.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values())
    assert np.isfinite(A.log_probs(w, c, c, 0)).all()


def test_model():
    """The gradient by differences; probabilities that sum to one; windows that score each token once."""
    import numpy as np

    from vecloom.llm import attention as A

    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in A.initial(np.log(np.full(64, 1 / 64))).items()}
    c, y = rng.integers(0, 64, (2, 3, 10))
    use = (rng.random((3, 10)) < 0.8).astype(float)
    _, grad = A.gradient(w, c, y, use)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[k][at], 1e-5
        w[k][at] = old + step
        up, _ = A.gradient(w, c, y, use)
        w[k][at] = old - step
        down, _ = A.gradient(w, c, y, use)
        w[k][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-6)
    total = sum(np.exp(A.log_probs(w, c[:1], np.full((1, 10), k), 0)) for k in range(64))
    assert np.allclose(total, 1)
    subwords = lm.Subwords(np.arange(3000.0))
    assert np.allclose(np.bincount(subwords.of, 10**subwords.share)[np.unique(subwords.of)], 1)
    weights = A.initial(subwords.prior)
    ids = rng.integers(0, 3000, 90)
    one = lm.model_scores(ids, np.array([0, 90]), weights, subwords)[0]
    parts = lm.model_scores(np.concatenate([ids, ids[:1], ids]), np.array([0, 90, 91, 181]), weights, subwords)
    assert parts[0] == pytest.approx(one) and parts[2] == pytest.approx(one)


def test_bounded_logits_are_skipped_only_where_none_is(monkeypatch):
    import numpy as np

    from vecloom.llm import attention as A

    rng = np.random.default_rng(3)
    c, y = rng.integers(0, 64, (2, 5, 12))
    for scale, small in ((1, True), (300, False)):
        w = A.initial(np.log(np.full(64, 1 / 64)))
        w["out"] *= scale
        h = rng.standard_normal((50, A.WIDTH)).astype(np.float32)
        head, heads = A._heads(w)
        assert A._small(h, head, heads) == small
        if small:
            got = A.log_probs(w, c, y, 0), A.gradient(w, c, y, np.ones(c.shape, np.float32))[1]
            monkeypatch.setattr(A, "_small", lambda *a: False)
            want = A.log_probs(w, c, y, 0), A.gradient(w, c, y, np.ones(c.shape, np.float32))[1]
            monkeypatch.undo()
            assert (got[0] == want[0]).all() and all((got[1][k] == want[1][k]).all() for k in want[1])


def test_packed_texts_give_their_words(public):
    """Subwords that are kept tell the words apart, and their hashes are those of the words that were cut: texts need no second cut."""
    import numpy as np

    path = public.path("byte_bpe_50k.json")
    texts = ["Some words, and&&& others***", "", None, " \t\n", "\xa0 \xa0 \xa0 x\xa0 \xa0y", "a<|endoftext|>b <|endoftext|>", "é　   \x1c \x1cz", "x" * 3000 + " don't 12,5", "Some"]
    cache, size = lm._coder(path)
    ((_, code, hashes, bounds, ids, sub),) = lm._texts(pa.array(texts), cache, size - 1)
    words = [w.encode() for t in texts for w in WORDS.findall((t or "").translate(LOWER))]
    assert len(code) == len(words) and len(hashes) == len(set(words)) == len(set(hashes.tolist()))
    assert len(set(zip(words, hashes[code].tolist(), strict=True))) == len(hashes)
    raw = ids.astype(lm._kind(size)).tobytes()
    width = len(raw) // len(ids)
    packed = pa.array([raw[width * s : width * e] for s, e in zip(sub[:-1].tolist(), sub[1:].tolist(), strict=True)], pa.binary())
    ((_, again, at, whole, places),) = lm._packed_texts(packed.slice(0), lm._kind(size), lm._openers(path))
    assert (again == hashes[code]).all() and (at == bounds).all() and (whole == ids).all() and (places == sub).all()
    parts = list(lm._packed_texts(packed.slice(4, 3), lm._kind(size), lm._openers(path)))
    assert np.array_equal(np.concatenate([p[1] for p in parts]), hashes[code][bounds[4] : bounds[7]])
    assert list(lm._packed_texts(packed.slice(1, 1), lm._kind(size), lm._openers(path)))[0][2].tolist() == [0, 0]
