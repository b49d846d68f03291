"""Operators on documents against brute force and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nightframe.llm import exact_dedup, language_id, ngram_join, packing, piece_codec, quality_classifier, quality_rules, subword, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "table", "none"])
def docs(request, llm, odd_docs, no_docs):
    return {"odd": odd_docs, "none": no_docs, "table": llm.read.parquet(f"{SF}/documents.parquet").repartition(5)}[request.param]


def test_quality_counts(docs):
    got = sorted(map(str, quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    want = []
    for i, t in rows_of(docs):
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        covered = {p for k, g in enumerate(grams) if count[g] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append(f"Row(doc_id={i}, n_words={len(w)}, word_chars={sum(map(len, w))}, n_symbols="
                    f"{sum(c in '#*$%&|<>' for c in t or '')}, n_dup_lines={len(lines) - len(set(lines))}, "
                    f"n_repeat_words={len(covered)}, base_failed={failed})")
    assert got == sorted(want)


def test_a_bad_host_takes_its_documents_along(llm):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good if k % 20 == 0 else "too short", "en", "bad" if k < 200 else "good", 1) for k in range(200)]
    rows += [(1000 + k, good, "en", "good", 1) for k in range(200)]
    kept = quality_rules.quality_rules(llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n int"))
    assert {r["source"] for r in kept.filter("kept").collect()} == {"good"}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(docs, n, percent):
    got = sorted(map(str, ngram_join.ngram_jaccard_join(docs, n=n, percent=percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()))
    rows, sets = rows_of(docs), []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up, links = list(range(len(rows))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
                links.update((a, b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    assert got == sorted(f"Row(doc_id={i}, n_shingles={len(sets[k])}, component_id={least.get(root(k))}, n_links={links[k]})" for k, (i, _) in enumerate(rows))


def test_blocks_of_a_large_group(llm, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(60)]
    rows.append((100, rows[7][1]))
    got = ngram_join.ngram_jaccard_join(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    want = {i: sum(100 * len(s & t) >= 90 * len(s | t) for t in sets) - 1 for (i, _), s in zip(rows, sets)}
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_rows_without_an_id_link_too(llm):
    base = [f"t{k}" for k in range(120)]
    rows = [(None, " ".join(base)), (5, " ".join([*base[:-1], "x"])), (7, " ".join(["y", *base[1:]]))]
    got = ngram_join.ngram_jaccard_join(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, 5, False), (5, 5, True), (7, 5, False)}
    assert all(r["n_links"] == 2 for r in got)


def test_exact_dedup(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for i, t in rows_of(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = Counter(
        (i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items() for i in g
    )
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("room", [1, 48])
def test_packing_is_gapless_and_exact(docs, room):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    ids = {}
    for i, t in rows_of(docs):
        ids.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    pieces = packing.pack_documents(docs, path, window_size=256, room=room).collect()
    found = Counter()
    for p in pieces:
        hits = [x for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]
                and zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]]
        assert hits
        found[(p["doc_id"], p["doc_tokens"])] += p["length"]
    want = Counter()
    for i, texts in ids.items():
        for x in texts:
            want[(i, len(x))] += len(x)
    assert found == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    if len(ids) > 100 and room == 48:
        assert sum(found.values()) / (256 * len(sequences)) > 0.98


def test_added_tokens_are_found_in_texts(llm):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y, <|startoftext|><|endoftext|> <|ENDOFTEXT|>", "\u00c9<|endoftext|>\u0338 <|endoftext|", "<|startoftext|>\x1c's"]
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    assert 49407 in ids[0] and 49406 in ids[1] and 49407 in ids[1]
    got = packing.pack_documents(llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()
    assert {(r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got} == {
        (k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ids.items()}


class Deaf:
    """A tokenizer whose calls fail, for words that must not need it."""

    def encode(self, *args, **kwargs):
        raise AssertionError(args)


def test_usual_words_are_split_and_merged_in_one_call_a_group():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordTokenizer(path)
    calls, model = [], words.model

    class Counted:
        def encode(self, parts, **kwargs):
            calls.append(len(parts))
            return model.encode(parts, **kwargs)

    texts = ["Grüße, schöne Straße! Élan d'été \u2014 don't", "Привет, мир. ΑΒΓ it'S \u201cquoted\u201d 42 \u20ac7", "schöne Grüße, Привет"]
    words.whole, words.model = Deaf(), Counted()
    ids, bounds = words.encode(texts)
    assert len(calls) == 1 and bounds.tolist()[-1] == len(ids)
    whole = Tokenizer.from_file(path)
    assert ids.tolist() == [i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 2]]
    words.encode(texts[::-1])
    assert len(calls) == 1


def test_a_worker_reads_the_tokenizer_once(tmp_path):
    path = tmp_path / "words.json"
    text = open(public_tokenizers.path("word_bpe_49k.json")).read()
    path.write_text(text)
    first = packing.word_tokenizer(str(path))
    assert packing.word_tokenizer(str(path)) is first
    path.write_text(text + " ")
    assert packing.word_tokenizer(str(path)) is not first


def test_ids_do_not_depend_on_what_was_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 40)
    monkeypatch.setattr(packing, "KNOWN_PARTS", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    words, whole = packing.WordTokenizer(path), Tokenizer.from_file(path)
    odd = ["", "\x1ca\x1d's", "ΣΑΣ İı ſt \u212bngström e\u0301t\u00e9", "<|endoftext|>é <|", "\x00\x7f \u00ad \u00b2\u00bc", "語 中文\u3000字"]
    for k in range(60):
        texts = [f"w{k} Wörter{k % 7}, x{k}y it's {odd[k % 6]}", odd[(k + 1) % 6], f"\u00c9{k % 13} {odd[(k + 2) % 6]} the the"]
        if k % 2:
            texts = [t.replace("\x1c", "").replace("\x1d", "") for t in texts]
        ids, bounds = words.encode(texts)
        for n, t in enumerate(texts):
            assert ids[bounds[n] : bounds[n + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]
    assert len(words.known) < 100


def test_token_counts(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = {model.id_to_piece(i): -float(np.log(r + 10.0)) for r, i in enumerate(ids)}
    low, known = min(pieces.values()) - 10.0, {}

    def count(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            options = []
            for size in range(1, min(j, 16) + 1):
                score, cost = pieces.get(word[j - size : j]), 1
                if score is None and size == 1:
                    cost = len(word[j - 1].encode())
                    score = low * cost
                if score is not None:
                    options.append((best[j - size][0] + score, best[j - size][1] - cost))
            best.append(max(options))
        return -best[-1][1]

    want = []
    for i, t in rows_of(docs):
        words = WORD.findall(t or "")
        for w in words:
            if w not in known:
                known[w] = count("▁" + w)
        want.append(str((i, len(words), sum(known[w] for w in words))))
    got = token_counts.token_counts(docs, path).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_tokens"])) for r in got) == sorted(want)


def test_piece_codec(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = piece_codec.encode_documents(docs, path, rate=0.2).collect()
    assert len(got) == docs.count() and all(r["lossless"] for r in got)
    again = piece_codec.encode_documents(docs.repartition(2), path, rate=0.2).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["ids_crc32"]) for r in again)
    plain = {(r["doc_id"], r["n_tokens"]) for r in piece_codec.encode_documents(docs, path, rate=0.0).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert plain == {(i, len(model.encode(t or ""))) for i, t in rows_of(docs)}
    if len(got) > 50:
        other = piece_codec.encode_documents(docs, path, seed=2, rate=0.2).collect()
        assert {r["ids_crc32"] for r in got} != {r["ids_crc32"] for r in other}


def test_space_marks_in_a_text_come_back():
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ["▁x ▁", " a  b\n\n", "日本 \U0001f600", "\n", " "]:
        ids, _ = codec.encode([text], [0], 3, 0.5)
        assert codec.decode(ids) == text


def test_every_occurrence_of_a_word_has_its_own_dropout(llm, monkeypatch):
    path, rate = public_tokenizers.path("piece_bpe_32k.model"), 0.3
    rows = [(k, "international") for k in range(300)] + [(None, "international " * 40)]
    got = piece_codec.encode_documents(llm.createDataFrame(rows, "doc_id bigint, text string"), path, rate=rate).collect()
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] is not None}) > 20
    codec = piece_codec.PieceCodec(path)
    (whole,) = [r["ids"] for r in got if r["doc_id"] is None]
    starts = [k for k, i in enumerate(whole) if codec.raw[codec.raw_at[i]] == 32]
    assert len({tuple(whole[a:b]) for a, b in zip(starts, starts[1:])}) > 10
    # Merging every occurrence anew gives the same ids as looking up those that skip no merge.
    text = "one international word, another one and an unbelievable \U0001f600 number of words\n" * 20
    ids, _ = codec.encode([text, "", text], [5, 6, 7], 3, rate)
    monkeypatch.setattr(codec, "_skipping", lambda codes, keys, rate: np.arange(len(codes)))
    all_anew, _ = codec.encode([text, "", text], [5, 6, 7], 3, rate)
    assert ids.tolist() == all_anew.tolist() and codec.decode(ids) == text + " " + text


def test_language_held_out_accuracy(llm, odd_docs, no_docs):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    got = language_id.language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)
    assert sum(r["rejected"] for r in got) < 0.02 * len(got)
    odd = {r["doc_id"]: r for r in language_id.language_id(odd_docs, model).filter("doc_id is not null").collect()}
    assert {i for i, r in odd.items() if r["lang_pred"] == "und"} == {4, 5, 6, 11}
    assert all(odd[i]["score"] == 0 and odd[i]["rejected"] for i in (4, 5, 6, 11))
    assert language_id.train(no_docs) is None
    assert language_id.language_id(odd_docs, None).filter("lang_pred <> 'und'").isEmpty()


def test_quality_held_out_accuracy(llm, odd_docs, no_docs):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.quality_scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) > 0.9 * len(got)
    assert all(r["predicted"] == 1 for r in got if r["quality"] == 1)
    scored = quality_classifier.quality_scores(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_classifier.train(no_docs, labels.limit(0)) is None


@pytest.mark.parametrize("left_out", ["de", "es"])
def test_language_left_out_is_rejected(llm, left_out):
    """Texts in a language that was not learned are rejected; few others are."""
    docs = llm.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("length(text) > 300")
    model = language_id.train(docs.filter(f"lang <> '{left_out}'"))
    rows = language_id.language_id(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    theirs = rows[rows["lang"] == left_out]
    others = rows[rows["lang"].notna() & (rows["lang"] != left_out)]
    assert theirs["rejected"].mean() > 0.97, theirs["rejected"].mean()
    assert others["rejected"].mean() < 0.01 and (others["lang_pred"] == others["lang"]).mean() > 0.98


def test_long_units_by_agenda_equal_the_rounds(monkeypatch):
    """The agenda gives the ids and merges that all units' rounds give, and a long unit takes seconds."""
    import time

    rng = np.random.default_rng(2)
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    letters = list("abcdethinsor日本語é")
    units = ["".join(rng.choice(letters, rng.integers(1, 400))) for _ in range(30)] + ["aaaa" * 120, "the" * 150]
    keys = rng.integers(0, 2**63, len(units), dtype=np.uint64)
    for rate in (0.0, 0.1, 0.5):
        got = []
        for long in (20, 10**9):
            monkeypatch.setattr(piece_codec, "LONG", long)
            made = []
            ids, bounds = codec.merge(units, keys, rate, made)
            got.append((ids.tolist(), bounds.tolist(), sorted((int(u), int(b)) for us, bs in made for u, b in zip(us, bs))))
        assert got[0] == got[1]
    monkeypatch.setattr(piece_codec, "LONG", 200)
    text = "".join(rng.choice(letters, 200_000))
    start = time.time()
    ids, _ = codec.encode([text], [7], 1, 0.1)
    assert codec.decode(ids) == text and time.time() - start < 60


def test_a_class_with_few_calibration_rows_has_the_shared_deviation():
    many, few, one = np.linspace(-1.0, 1.0, 40), np.array([2.0, 2.01, 2.02]), np.array([5.0])
    least = subword.least_evidence([many, few, one, few[:0]], 4.0)
    assert least[0] == many.mean() - 4.0 * many.std()
    assert -1.0 < least[1] < 2.01 - 3.0 * many.std()  # its own deviation is 0.008
    assert list(least[2:]) == [-np.inf, -np.inf]
    assert list(subword.least_evidence([one, one], 4.0)) == [-np.inf, -np.inf]
