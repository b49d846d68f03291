"""Language-model scores, hard negatives and the filter audit against plain Python."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.llm import filter_audit, hard_negatives, lm_scoring, maxent


SF = "/root/testdata/sf0.001"


def words_of(text):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").translate(low).split(" ") if w]


# --- language model -----------------------------------------------------------
def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base_by_hand(rows):
    texts = [(i, [*words_of(t), None]) for i, t in rows]
    counts = collections.Counter(w for i, ws in texts if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return collections.Counter(
        (i, held(i), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for i, ws in texts
    )


def seen(rows):
    return collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_counts_and_base_scores(llm, odd_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_CHARS", 1500)
    got = lm_scoring.lm_scores(odd_docs).collect()
    assert seen(got) == base_by_hand([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_no_rows_and_no_training_rows(llm, no_docs):
    assert lm_scoring.lm_scores(no_docs).isEmpty()
    only = next(i for i in range(100) if held(i))
    rows = lm_scoring.lm_scores(llm.createDataFrame([(only, "a b")], "doc_id bigint, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows] == [(3, 0, 0, 0.0)]
    assert math.isfinite(rows[0]["score"])


def path_by_hand(model, history, cell):
    """log10 probability of a cell after (w2, w1), choice by choice."""
    words = np.array([*history, 0], np.uint64)
    features = [f[-1:] for f in maxent.history_features(words, np.arange(len(words)))]
    total = 0.0
    for depth in range(maxent.DEPTH):
        path = sum(maxent.WAYS**d for d in range(depth)) + cell // maxent.WAYS ** (maxent.DEPTH - depth)
        score = model.bias[path].astype(float)
        for row in model.rows(features, np.array([path])):
            score = score + model.weights[row[0]]
        choice = cell // maxent.WAYS ** (maxent.DEPTH - 1 - depth) % maxent.WAYS
        total += score[choice] - np.log(np.exp(score).sum())
    return total / math.log(10)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = lm_scoring.tokenised(docs)
    words = lm_scoring.vocabulary(chunks)
    return docs, chunks, words, lm_scoring.train(chunks, words)


def test_probabilities_sum_to_one(trained):
    _, _, words, t = trained
    assert np.abs(t.model.weights).max() > 0.1
    history = np.array([7, 11], np.uint64)
    cells = 10.0 ** np.array([path_by_hand(t.model, history, c) for c in range(maxent.CELLS)])
    assert cells.sum() == pytest.approx(1, abs=1e-5)
    rows = words.collect()
    known = np.concatenate([lm_scoring.unpacked_words(r["words"]) for r in rows])
    counts = np.concatenate([lm_scoring.unpacked(r["counts"]) for r in rows])
    total = cells[maxent.HEAD :].sum() * t.unseen
    for h, n in zip(known, counts):
        (c,) = t.cells(np.array([h]))
        total += cells[c] * (1 if c < maxent.HEAD else (1 - t.unseen) * n / t.cell_tokens[c])
    # shared cells without a training word keep a little for words to come
    assert 0.9 < total <= 1 + 1e-5


def test_scores_equal_a_plain_sum(trained, llm):
    docs, chunks, words, t = trained
    rows = {r["doc_id"]: r for r in lm_scoring.score(chunks, words, t).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.limit(12).collect()}
    vocabulary = {}
    for r in words.collect():
        vocabulary |= dict(zip(lm_scoring.unpacked_words(r["words"]).tolist(), lm_scoring.unpacked(r["counts"]).tolist()))
    from nightframe.llm.words import hashed_words

    for i, text in texts.items():
        stream = np.append(hashed_words([text])[1], lm_scoring.END)
        total = 0.0
        for k, h in enumerate(stream.tolist()):
            history = stream[:k]
            if h in vocabulary:
                (c,) = t.cells(np.array([h], np.uint64)).tolist()
                total += path_by_hand(t.model, history, c)
                total += math.log10((1 - t.unseen) * vocabulary[h] / t.cell_tokens[c]) if c >= maxent.HEAD else 0
            else:
                features = [f[-1:] for f in maxent.history_features(np.append(history, np.uint64(0)), np.arange(k + 1))]
                p, _ = t.model.choices(features, np.zeros(1, np.int64))
                total += math.log10(p[0, maxent.WAYS // 2 :].sum() * t.unseen)
        assert rows[i]["score"] == pytest.approx(total, rel=1e-3), i


def test_gradients_add_up_over_parts_and_rounds_cover_all(trained):
    _, chunks, _, t = trained
    zero = np.zeros(t.model.weights.shape, np.float32)
    whole, parts = (zero.copy(), zero.copy()), (zero.copy(), zero.copy())
    tokens = 0
    for r in chunks.collect():
        chunk = lm_scoring.Chunk.of(r["sizes"], r["words"], r["at"])
        words, cells, learned = chunk.words[chunk.at], t.cells(chunk.words)[chunk.at], chunk.learned(r["held"])
        use = np.flatnonzero(learned)
        t.model.add_gradient(words[use], chunk.first[use], cells[use], *whole)
        tokens += len(use)
        for k in range(3):
            use = np.flatnonzero(learned & chunk.in_round(r["doc_ids"], k, 3))
            t.model.add_gradient(words[use], chunk.first[use], cells[use], *parts)
    assert tokens == t.tokens and whole[0].sum() == pytest.approx(tokens * 9)
    for a, b in zip(whole, parts):
        np.testing.assert_allclose(a, b, rtol=1e-3, atol=1e-2)
    assert whole[1].sum() == pytest.approx(whole[0].sum(), rel=1e-4)


def test_model_beats_counts_on_texts_held_out(llm):
    rows = lm_scoring.lm_scores(llm.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").toPandas()
    assert rows["score"].sum() > 0.85 * rows["base_score"].sum()
    assert (rows["score"] > rows["base_score"]).mean() > 0.9


# --- hard negatives -------------------------------------------------------------
def mined_by_hand(rows, every=50, relabelled=7):
    sound = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, [math.floor(256 * float(x)) for x in v], math.fmod(label + 1, 10) if i % relabelled == 0 else label))
    out = []
    for a, (i, q, label) in enumerate(sound):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), j, other) for b, (j, p, other) in enumerate(sound) if b != a]
        positives = sorted((s, j) for s, j, other in scored if other == label)[:5]
        for s, j in positives:
            left = sorted((t, k) for t, k, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(left, 1)]
    return collections.Counter(out)


def vectors(llm, rows):
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return df.withColumn("rid", F.lit(1)).withColumn("task", F.lit("x")).withColumn("q", F.lit(None).cast("binary"))


def mined(df):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(tuple(r[c] for c in columns) for r in hard_negatives.hard_negatives(df).collect())


@pytest.mark.parametrize("scale", [1.0, 30.0, 1e4])
def test_hard_negatives_equal_brute_force(llm, monkeypatch, scale):
    """Clusters, ties, copies and odd rows, over many small blocks; large numbers need wider sums."""
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 12))
    rows = []
    for i in range(0, 400):
        c = rng.integers(0, 6)
        x = np.float32(scale * (centres[c] + rng.normal(0, 0.3, 12)))
        rows.append((i, [float(v) for v in x], int(c if rng.random() < 0.8 else rng.integers(0, 6))))
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(9)]  # copies: ties
    rows += [rows[50], rows[50], rows[51]]  # repeated rows, an anchor among them
    rows += [(2000, None, 1), (2050, [1.0] * 12, None), (None, rows[0][1], 1), (2100, [float("nan")] * 12, 1), (2150, [float("inf")] * 12, 1),
             (2200, [1.0, None], 1), (2250, [0.5 * scale] * 5, 2), (2300, [], 3), (2350, [-x for x in rows[0][1]], 4)]
    want = mined_by_hand([(i, v and [None if x is None else np.float32(x) for x in v], label) for i, v, label in rows])
    assert len(want) > 50 and mined(vectors(llm, rows)) == want


def test_hard_negatives_of_nothing(llm):
    assert not mined(vectors(llm, []))
    assert not mined(vectors(llm, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]))  # no anchors
    assert not mined(vectors(llm, [(50, [1.0, 2.0], 1)]))
    assert mined(vectors(llm, [(50, [], 1), (51, [], 1), (52, [], 2)])) == {(50, 51, 1, 52, 0, 0): 1}


def test_bounds_hold_and_rule_pairs_out(monkeypatch):
    rng = np.random.default_rng(6)
    spread = np.repeat(rng.normal(0, 1, (8, 8)), 8, axis=1)  # segments of nearly equal values
    x = np.floor(256 * (spread[rng.integers(0, 8, 300)] + rng.normal(0, 0.02, (300, 64)))).astype(np.int64)
    block = hard_negatives.Block(np.arange(300), np.arange(300), np.sort(np.arange(300) % 4), x)
    exact, widths = x @ x.T, []
    for level in range(len(hard_negatives.LEVELS)):
        low, high = hard_negatives.bounds(block, block, level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append(float((high - low).mean()))
    assert widths == sorted(widths, reverse=True) and widths[-1] < 0.1 * widths[0]
    scored = []
    real = hard_negatives.exact_scores
    monkeypatch.setattr(hard_negatives, "exact_scores", lambda a, b, alive: scored.append(alive.sum()) or real(a, b, alive))
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    hard_negatives.positives_in(block.take(slice(0, 20)), block, 5)
    asked = sum((block.label == label).sum() - 1 for label in block.label[:20])
    assert sum(scored) < 0.8 * asked


# --- filter audit ----------------------------------------------------------------
def test_intervals_equal_a_walk_through_all_orders():
    orders = list(itertools.permutations(range(5)))
    for mask in range(32):
        want = {}
        for rank, order in enumerate(orders):
            step = next((k for k, letter in enumerate(order, 1) if mask >> letter & 1), None)
            if step:
                want[rank] = step
        got = {}
        for step, low, high in filter_audit.removal_intervals(mask):
            for rank in range(low, high):
                assert rank not in got
                got[rank] = step
        assert got == want


def audit_by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = collections.defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""].append(i)
    rows = []
    for i, t, source in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and min(texts[t]) < i else set()
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                failing = [r for r in mine if letter in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == {letter} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[letter] += len(gone)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def audited(docs, labels):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_audit.filter_audit(docs, labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_brute_force(llm, odd_docs):
    shared = " ".join(f"w{k}" for k in range(60))
    more = [(20, shared, "en", "s", 1), (21, shared, "en", "s", 1), (22, shared, "en", None, 1), (22, shared, "en", "", 1), (None, shared, "en", "s", 1),
            (23, "A B C " * 30, "en", "s", 1), (24, shared + " #", "en", "s0", 1), (25, None, "en", "s0", 1), (26, "", "en", "s", 1)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        llm.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ).withColumn("mask", F.lit("x")).withColumn("part", F.lit(3)).withColumn("good", F.lit(None).cast("int"))
    labels = [(20, 1, 0), (21, 1, 1), (22, 0, 1), (22, 1, None), (None, 1, 1), (23, None, 1), (24, 1, 0), (999, 1, 1)]
    marks = llm.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert audited(docs, marks) == audit_by_hand(rows, labels)


def test_audit_of_nothing(llm, no_docs):
    marks = llm.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert not audited(no_docs, marks)
    one = llm.createDataFrame([(1, "a", None)], "doc_id bigint, text string, source string")
    assert len(audited(one, marks.limit(0))) == 600
