"""Operators over the whole corpus (collocations, lexical search, exact copies), held against plain versions of their rules."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np

from agentlens.llm import collocations, exact_copies, lexical_search, neighbours, secrets

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, vocabulary=60):
    return "".join(rng.choice(["Wort", "ÄÖ", "the", "x"]) + str(int(vocabulary * rng.random() ** 2)) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(n))


# ---- exact copies


def plain_copies(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and how many rows of each (id, text) stay."""
    texts = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, texts):
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, least[t], len(groups[t]), sha(t)) for (i, _), t in zip(rows, texts)), key=str), len(groups)


def copies_of(df):
    rows = df.collect()
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str), rows


def odd_texts():
    rng = random.Random(5)
    long = prose(rng, 40000)
    near = long[:200_000] + "!" + long[200_000:]
    return [long, near, long.replace(" ", "\n\t"), "", None, " ", "\n", "a", "a ", " a", "a" * 100_000, "a" * 99_999, "漢字かな交じり文" * 5000, "😀" * 20000, "😀" * 20000 + "x", "x\0y", long, "a"]


def test_copies_equal_plain_groups(spark):
    texts = odd_texts()
    rows = [(i * 7 % 19 if i % 6 else None, t) for i, t in enumerate(texts)] + [(3, "twice"), (3, "twice"), (None, "none"), (None, "none")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id bigint, text string, _recipe string, kept int").repartition(3)
    told, n_groups = plain_copies(rows)
    for bits in (64, 2, 0):  # with few bits most chunks share their hash with others
        got, out = copies_of(exact_copies.exact_copies(docs, bits=bits))
        assert got == told
        kept = [r for r in out if r["kept"]]
        assert len(kept) == n_groups and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_copies.without_copies(docs)
    assert left.columns == docs.columns and left.count() == n_groups
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r["doc_id"]) for r in kept)


def test_chunks_follow_content(spark):
    rng = random.Random(8)
    a = re.sub(r"\s+", " ", prose(rng, 30000, 5000))
    got = spark.createDataFrame([(a,), ("new words in front of it, " + a,)], "t string").select(exact_copies.chunks(exact_copies.F.col("t")).alias("c")).collect()
    one, two = (r["c"] for r in got)
    assert "".join(one) == a and max(map(len, one)) <= exact_copies.MOST and len(one) > 50
    assert len(set(one) & set(two)) > 0.9 * len(one)


def test_copies_of_nothing_and_of_a_hot_group(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_copies.exact_copies(empty).count() == 0 and exact_copies.without_copies(empty).count() == 0
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('same words ', 200), concat('text ', id)) as text")
    rows = exact_copies.exact_copies(docs).collect()
    assert sum(r["kept"] for r in rows) == 2001 and {r["group_size"] for r in rows} == {1, 1000} and {r["keep_id"] for r in rows if r["group_size"] > 1} == {0}


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(items, docs, k=50):
    each = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := TERM.findall((t or "").translate(LOWER)))]
    n_docs, n_terms, df = len(each), sum(n for *_, n in each), Counter(t for _, c, _ in each for t in c)
    found = []
    for item, text in items:
        own = {t for t in TERM.findall((text or "").translate(LOWER)) if t in df}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scores = [(-sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms))) for t in own if c[t]), i is None, i or 0, i) for i, c, n in each]
        found += [(item, rank + 1, i, -s) for rank, (s, *_, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(found, key=str)


def search_of(spark, items, docs, **more):
    left = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, item string")
    right = spark.createDataFrame([(*r, 5) for r in docs], "doc_id bigint, text string, block int").repartition(3)
    return sorted((tuple(r) for r in lexical_search.search(left, right, **more).collect()), key=str)


def test_search_equals_plain_scores(spark):
    rng = random.Random(11)
    docs = [(i, prose(rng, rng.choice([1, 5, 40, 200]))) for i in range(900)] + [(i, "the same text, again") for i in range(900, 1000)]
    docs += [(1000, None), (1001, ""), (1002, "..,"), (None, "the only ÄÖ1 here"), (1003, "wort1 " * 50000 + prose(rng, 3000)), (5, "the5 the5"), (5, "the5 the5"), (-4, "WORT1 the1")]
    items = [(1, "the1 The1, WORT2 x3"), (2, "ÄÖ1 äö1"), (3, None), (4, ""), (5, "nowhere atall"), (6, docs[7][1]), (7, prose(rng, 500)), (8, "same text"), (None, "the2"), (1, "x9"), (9, "only")]
    assert search_of(spark, items, docs) == plain_search(items, docs)
    assert search_of(spark, items[:2], docs, k=3) == plain_search(items[:2], docs, 3)


def test_search_of_nothing(spark):
    assert search_of(spark, [], [(1, "a")]) == [] and search_of(spark, [(1, "a")], []) == [] and search_of(spark, [(1, "a")], [(1, None), (2, "!")]) == []


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    """A task in this process, groups of a few blocks one after another: from the third good one on only blocks whose bound reaches the best scores are scored, and with the threshold of the first round no others at all."""
    import pyarrow as pa

    texts = [("rare word in it " if i % 20 == 0 else "") + "common text about a thing " * 3 for i in range(60)]
    rows = []
    for n, t in enumerate(texts):
        own = Counter(lexical_search.terms(t))
        counts = np.array(list(own.values()), np.int32)
        size = np.full(len(own), sum(own.values()))
        rows.append({"block": n, "terms": [w.decode() for w in own], "dfs": [1] * len(own), "maxima": lexical_search.impacts(counts, size, 60, 900), "doc_ids": [n], "lengths": [int(size[0])], "starts": [0, len(own)], "numbers": list(range(len(own))), "counts": counts})
    batch = pa.RecordBatch.from_pylist(rows, schema=lexical_search.INDEX)
    lot, scored = lexical_search.Lot([(0, {"rare": 3000, "word": 3000, "common": 10})]), []
    plain = lexical_search.Lot.scores
    monkeypatch.setattr(lexical_search.Lot, "scores", lambda self, block, *a: scored.append(block["block"]) or plain(self, block, *a))
    out = pa.Table.from_batches(lexical_search.scored(lot, 3, {}, 60, 900)(iter([batch])))
    assert out["doc_id"].to_pylist() == [0, 20, 40] and max(scored) == 40
    scored.clear()
    again = pa.Table.from_batches(lexical_search.scored(lot, 3, {0: out["score"].to_pylist()[-1]}, 60, 900)(iter([batch])))
    assert again.equals(out) and scored == [0, 20, 40]


# ---- collocations


def plain_collocations(docs, least, longest=5, top=2000, share=100):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = []
    for lang, f in counts.items():
        rows, frequent = [], {p: a for p, a in f.items() if a >= least}
        inside = defaultdict(int)
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        for p, a in frequent.items():
            if len(p) > 1 and not (p in inside and 100 * inside[p] >= share * a):
                score, cut = min((1000 * a * totals[lang] // (f[p[:j]] * f[p[j:]]), j) for j in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]], cut))
        for rank, (s, a, p, left, right, cut) in enumerate(sorted(rows)[:top]):
            found.append((lang, rank + 1, p.decode(), -a, left, right, totals[lang], -s, cut))
    return sorted(found, key=str)


def mined(spark, docs, **more):
    df = spark.createDataFrame([(r[1], r[0], "f") for r in docs], "text string, lang string, phrase string").repartition(3)
    return sorted((tuple(r) for r in collocations.collocations(df, **more).collect()), key=str)


def test_collocations_equal_plain_counts(spark):
    rng = random.Random(3)
    docs = [(rng.choice(["de", "en", "en", "en", None, ""]), prose(rng, rng.choice([3, 50, 400]), 12)) for _ in range(300)]
    docs += [("en", "a a a a a a a, A a"), ("en", None), (None, ""), ("fr", "un deux"), ("en", "one two three four five. " * 40), ("en", " . ,\t"), ("en", docs[0][1])] * 2
    assert mined(spark, docs, least=20) == plain_collocations(docs, 20)
    assert mined(spark, docs, least=5, top=7) == plain_collocations(docs, 5, top=7)
    assert mined(spark, docs, least=20, longest=3, share=80) == plain_collocations(docs, 20, 3, share=80)


def test_first_rows_are_sought_in_shares(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROUND", 2)
    rng = random.Random(4)
    docs = [("en", prose(rng, 400, 12)) for _ in range(100)]
    assert mined(spark, docs, least=5, top=11) == plain_collocations(docs, 5, top=11)


def test_collocations_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "too few words")]) == []


def test_parts_of_a_long_text_add_up():
    """Parts of seven words that overlap by k-1, as a task cuts a text of more than `BLOCK_WORDS`."""
    found = Counter()
    tokens = collocations.words("a b c d e f g h. a b c d e f g h i j k l m n o p " * 30)

    for k in (1, 3):
        found.clear()
        every = collocations.Filter(64, np.array([0]), np.array([2**64 - 1], np.uint64))
        for at in range(0, len(tokens), 7):
            for p, n in zip(*collocations.counted_phrases("en", [*tokens[at : at + 7 + k - 1], collocations.END], k, every)):
                found[p.as_py()] += int(n)
        pieces = " ".join(t.decode() for t in tokens).split(".")
        told = Counter(" ".join(ws[i : i + k]) for p in pieces for ws in [p.split()] for i in range(len(ws) - k + 1))
        assert found == told


# ---- very long texts and extreme vectors in other operators


def test_secrets_of_a_text_with_very_many(spark):
    text = " ".join(f"{i:032x} token={i:010d} x" for i in range(20_000))
    began = time.time()
    (row,) = secrets.find_secrets(spark.createDataFrame([(1, text, "clash")], "doc_id bigint, text string, spans string")).collect()
    assert time.time() - began < 60
    told = [(s["start"], s["kind"], s["end"]) for s in row["spans"] if s["kind"] in ("hex", "assign")]
    want = [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]{32,}", text)] + [(m.start(), "assign", m.end()) for m in re.finditer("token=[0-9]{10}", text)]
    assert told == sorted(want)


def test_neighbours_of_extreme_vectors(spark):
    rows = [(50, [1.0, 1.0]), (1, [0.0, 1e-200]), (2, [1e200, 0.0]), (3, [1e-300, 1e-300]), (4, [1e300, 1e300]), (5, [-1e-320, 0.0]), (100, [1e-310, 1e-310]), (3, [1e-300, 1e-300]), (3, [5.0, 4.0]), (6, []), (7, [1.0, float("nan")])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 12)) for r in neighbours.nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"), k=9).collect()}
    half = round(math.sqrt(0.5), 12)
    assert {got[(50, n)] for n in (1, 2, 3)} == {(3, 1.0), (4, 1.0), (100, 1.0)}  # equal but for the last digit
    assert [got[(50, n)] for n in range(4, 8)] == [(3, round(9 / math.sqrt(82), 12)), (1, half), (2, half), (5, -half)]
    assert {got[(100, n)][0] for n in range(1, 4)} == {3, 4, 50} and (50, 8) not in got
