"""Page extraction, chat collapse, and the registered queries against SQL."""

import itertools
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, compare
from nightframe.llm import chat_format, html_extract, language_id, ngram_join, packing
from nightframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(llm, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(QUERIES[name](llm, SF).toPandas(), con.execute(ORACLES[name]).df()) == "ok"


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def chats(llm, rows):
    return llm.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_snapshots_collapse(llm, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x")]
    rows = [(c, k, *turns[k]) for c, n in ((1, 1), (2, 3), (3, 4), (4, 4), (5, 2)) for k in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (None, 0, "user", "hi"), (7, None, "user", ""), (7, None, "user", "")]
    got = {r["conv_id"]: r for r in chat_format.collapse_snapshots(chats(llm, rows)).collect()}
    assert set(got) == {3, 6, 7}
    assert got[3]["copies"] == 2 and got[3]["n_turns"] == 4
    assert got[3]["text"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\n<|end|>\n<|unknown|>\nx<|end|>\n"
    assert got[7]["n_turns"] == 2
    assert chat_format.collapse_snapshots(chats(llm, [])).isEmpty()


def pages(llm, rows):
    return llm.createDataFrame(rows, "page_id bigint, url string, html string")


def texts(llm, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages(llm, rows)).collect()}


def test_marked_furniture_goes(llm):
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav>'
        '<div class="ad">Buy<p>now</div><main><h1>One &amp; two</h1><p>Three  <b>fo</b>ur<br>five<p>six &lt;b&gt;'
        '<script>var x="</p>";</script><div id="comments"><article><p>me too</p></article></div></main>'
        '<aside>side</aside><form>q<input></form><footer>&copy; x</footer>'
    )
    assert texts(llm, [(1, "http://h/a", page), (2, None, None), (None, "http://h/b", "")]) == {
        1: "One & two\nThree four five\nsix <b>", 2: "", None: ""}


def test_repeated_runs_of_a_host_go_and_own_runs_stay(llm):
    own = lambda k: " ".join(f"word{k}x{j}" for j in range(6))
    frame = "<div>read our other stories on this great site today</div>"
    rows = [(k, f"https://a.org/{k}", f"<body>{frame}<div>{own(k)}</div></body>") for k in range(4)]
    rows.append((9, "https://b.org/1", f"<body>{frame}</body>"))
    copied = "<article><p>a copied article of some ten words or even more stays</p></article>"
    rows += [(20, "https://a.org/x", copied), (21, "https://a.org/y", copied)]
    got = texts(llm, rows)
    assert [got[k] for k in range(4)] == [own(k) for k in range(4)]
    assert got[9] == "read our other stories on this great site today"
    assert got[20] == got[21] == "a copied article of some ten words or even more stays"


def prose(key, n):
    return " ".join(f"word{key}x{j}" for j in range(n))


def test_template_text_inside_articles_goes_and_copied_articles_stay(llm):
    line = "subscribe now and read all our stories every single day"
    page = lambda body, more="": f"<nav>menu</nav><article><p>{body}</p><p>{line}</p>{more}</article>"
    rows = [(k, f"https://a.org/{k}", page(prose(k, 30))) for k in range(6)]
    # Ten near copies of one article, with the line, and their notes; on b.org they are all there is.
    for host, at in (("a", 100), ("b", 200)):
        rows += [(at + k, f"https://{host}.org/c{k}", page(prose("same", 60), f"<p>{prose(f'note{k}', 5)}</p>")) for k in range(10)]
    got = texts(llm, rows)
    assert [got[k] for k in range(6)] == [prose(k, 30) for k in range(6)]
    assert [got[100 + k] for k in range(10)] == [f"{prose('same', 60)}\n{prose(f'note{k}', 5)}" for k in range(10)]
    assert [got[200 + k] for k in range(10)] == [f"{prose('same', 60)}\n{line}\n{prose(f'note{k}', 5)}" for k in range(10)]


def test_copied_and_quoted_bodies_without_article_stay(llm):
    site = "<div>this site is made for all of its readers by nobody in particular</div>"
    page = lambda head, body: f"<body><div>{head}</div><div id=content><p>{body}</p></div>{site}</body>"
    quote = prose("quote", 12)
    bodies = {k: prose(k, 40) for k in range(8)}
    bodies |= {k: f"{prose(k, 20)} {quote} {prose(f'z{k}', 20)}" for k in range(8, 14)}  # a passage of six pages
    bodies |= {k: prose("twice", 50) for k in range(14, 16)}
    pool = [prose(f"pool{k}", 10) for k in range(12)]
    bodies |= {16 + k: " ".join(pool[(k * j + k) % 12] for j in (1, 5, 7)) for k in range(12)}  # made of common sentences
    got = texts(llm, [(k, f"https://a.org/{k}", page(f"day {k}", b)) for k, b in bodies.items()])
    assert got == {k: f"day {k}\n{b}" for k, b in bodies.items()}


def test_pipeline_stages(llm, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language ID":
            continue  # nothing to learn from here
        docs = llm.createDataFrame(stage(llm, docs, SF).collect(), docs.schema)
        assert docs.columns == odd_docs.columns
        if name == "quality rules":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "10", "2", "2", "3", "None"]
            assert {r["n_words"] for r in docs.collect()} == {7}
        if name == "exact dedup":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "10", "2", "3"]
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 10]


def test_language_stage_without_labels_keeps_texts_with_letters(llm, odd_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language(llm, docs, SF)
    want = [r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in got.collect()) and got.columns == docs.columns


def test_pipeline_equals_its_stages_by_hand(llm):
    kept = corpus_pipeline.run(llm, SF).select("doc_id").distinct().collect()
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {r["doc_id"] for r in kept}
    words = {i: t.split() for i, t in rows.items()}
    assert all(len(words[i]) >= 50 for i in ids)
    assert len({" ".join(words[i]) for i in ids}) == len(ids)
    left = docs.filter(docs.doc_id.isin(list(ids)))
    assert ngram_join.ngram_jaccard_join(left, n=5, percent=80).filter("component_id <> doc_id").isEmpty()
    assert len(ids) > 0.7 * len(rows)
    assert packing.WINDOW == 4096


def test_pages_give_the_article_and_nothing_else(llm):
    """All pages of a table: the headline and the text of one document, white space aside."""
    sf = "/root/testdata/sf0.1"
    known = {" ".join((r["text"] or "").split()) for r in llm.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    got = QUERIES["op6_html_extraction"](llm, sf).collect()
    assert len(got) == 2500
    for r in got:
        headline, _, body = r["text"].partition("\n")
        body = " ".join(body.split())
        assert body in known and body.startswith(headline[:20]) and r["n_chars"] == len(r["text"])


def cleaned_by_hand(pages):
    """Blocks without the units that stand on half of a host's different pages, four at least (each page its own article)."""
    hosts, out = {}, {}
    for i, url, html in pages:
        hosts.setdefault(url.split("/")[2], []).append((i, html_extract.page_blocks(html)))
    for mine in hosts.values():
        held = {}
        for i, blocks in mine:
            for a in range(len(blocks)):
                words, b = [], a
                while b < len(blocks) and len(words) < html_extract.RUN:
                    words += blocks[b].split()
                    b += 1
                if len(words) >= html_extract.RUN:
                    held.setdefault(tuple(blocks[a:b]), {}).setdefault(i, []).append(range(a, b))
        gone = {i: set() for i, _ in mine}
        for where in held.values():
            if len(where) >= max(4, len(mine) / 2):
                for i, spans in where.items():
                    gone[i].update(k for span in spans for k in span)
        out |= {i: "\n".join(b for k, b in enumerate(blocks) if k not in gone[i]) for i, blocks in mine}
    return out


@pytest.mark.parametrize("chunk", [3, 4096])
def test_units_equal_brute_force(llm, monkeypatch, chunk):
    """Templates of one or several blocks on some of a host's pages, common lines, over small chunks too."""
    import random

    monkeypatch.setattr(html_extract, "CHUNK_PAGES", chunk)
    rng = random.Random(5)
    common = [prose(f"common{k}", 9) for k in range(6)]
    pages_of = []
    for host, n in (("a", 30), ("b", 9), ("c", 3)):
        for k in range(n):
            own = [prose(f"{host}{k}p{j}", rng.randint(20, 40)) for j in range(4)] + rng.sample(common, 2)
            rng.shuffle(own)
            template = ["Menu of the site", "Home and news", "All about us"] if rng.random() < 0.9 else ["Menu of the site"]
            rare = [prose(f"rare{host}", 12)] if rng.random() < 0.3 else []
            body = "".join(f"<div>{b}</div>" for b in [*template, *rare, *own, prose(f"foot{host}", 10)])
            pages_of.append((len(pages_of), f"https://{host}.org/{k}", f"<html><body>{body}</body></html>"))
    want = cleaned_by_hand(pages_of)
    assert any("Menu" not in t for t in want.values()) and any("Menu" in t for t in want.values())
    assert texts(llm, pages_of) == want


def test_broken_pages_take_linear_time_and_odd_tables_work(llm):
    import time

    start = time.time()
    for page in ("<a " * 170_000 + '">"', "<div>" * 100_000 + "</x>" * 100_000, "<p title='" * 50_000, "<" * 1_000_000, "<!--" * 100_000,
                 "<x " + "a" * 1_000_000 + ">", "<article>" + "<div class=comment><article></article>" * 20_000):
        html_extract.page_blocks(page)
    assert time.time() - start < 30
    assert html_extract.page_blocks('<p title="is hidden here">text</p><p hidden>no</p><p>1 &lt; 2 <a href=x>l</a>') == ["text", "1 < 2 l"]
    long = "<article>" + "".join(f"<p>{prose(k, 20)}</p>" for k in range(3000)) + "</article>"
    rows = [(1, "http://h/1", long), (1, "http://h/1", long), (None, None, None), (2, "", "")]
    extra = pages(llm, rows).withColumn("host", F.lit(1)).withColumn("blocks", F.lit("x")).withColumn("rid", F.lit(0))
    got = html_extract.extract_main_text(extra).collect()
    assert sorted(len(r["text"].split("\n")) if r["text"] else 0 for r in got) == [0, 0, 3000, 3000]
    assert html_extract.extract_main_text(pages(llm, [])).isEmpty()


def linked_by_hand(texts, n, percent):
    """The smallest id reachable by links of every text's id."""
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    smallest = {i: i for i in texts}

    def top(i):
        while smallest[i] != i:
            i = smallest[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            smallest[b] = a
    return {i: top(i) for i in texts}


def test_pipeline_equals_plain_python_exactly(llm):
    """The ids that every stage keeps, and the packed pieces: SQL for the rules, the operator's flags for the languages, plain loops after."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = con.execute(f"SELECT doc_id FROM ({ORACLES['op1_quality_rules']}) WHERE kept").df()["doc_id"].tolist()
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    texts_of = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(texts_of) == docs.count()  # ids are unique here
    step = docs.filter(docs.doc_id.isin(kept))
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality(llm, docs, SF).collect()) == sorted(kept)
    judged = language_id.language_id(step, language_id.train(step, deviations=corpus_pipeline.DEVIATIONS)).collect()
    kept = sorted(r["doc_id"] for r in judged if not r["rejected"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(llm, step, SF).collect()) == kept
    step = docs.filter(docs.doc_id.isin(kept))
    first = {}
    for i in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts_of[i]), i)
    kept = sorted(first.values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.exact(llm, step, SF).collect()) == kept
    step = docs.filter(docs.doc_id.isin(kept))
    top = linked_by_hand({i: texts_of[i] for i in kept}, 5, 80)
    kept = sorted(set(top.values()))
    assert 0 < len(kept) < len(top)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(llm, step, SF).collect()) == kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(llm, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert sorted(pieces) == kept
    for i, mine in pieces.items():
        ids, at = [*tokenizer.encode(texts_of[i], add_special_tokens=False).ids, 2], 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)


def test_stages_of_empty_tables(llm, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(llm, no_docs, SF)
        assert got.isEmpty() and (name == "packing" or got.columns == no_docs.columns), name


def test_pipeline_beside_another_query(llm):
    """A query in another thread keeps its intermediates while the pipeline's stages remove theirs."""
    import threading

    found, failed = [], []

    def other():
        try:
            for _ in range(3):
                found.append(QUERIES["op5_exact_dedup"](llm, SF).count())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    thread = threading.Thread(target=other)
    thread.start()
    rows = corpus_pipeline.run(llm, SF).count()
    thread.join()
    assert not failed and found == [200] * 3 and rows > 0
