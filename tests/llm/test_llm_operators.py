"""Each operator on odd rows and against brute force or exact round trips."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sievework.llm import boosting, pseudo_lm, queries
from sievework.llm.chat import maximal_conversations, render
from sievework.llm.components import components
from sievework.llm.dart_minhash import DartSketch, keep_first, near_duplicates
from sievework.llm.decontaminate import contaminated, drop_contaminated
from sievework.llm.extract import blocks, extract, main_text
from sievework.llm.induced_sort import suffix_order
from sievework.llm.piece_lattice import decode_documents, encode_documents
from sievework.llm.quality_rules import keep_documents, score_documents, train
from sievework.llm.suffix_dedup import dedup_spans, remove_repeats
from sievework.llm.token_store import EliasFano, Segment, pack_segment, token_store
from sievework.llm.url_filter import judge_urls

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        v = np.sort(rng.integers(0, 10**6, n))
        code, _ = EliasFano.from_bytes(EliasFano.encode(v).to_bytes(), 0)
        assert code.decode().tolist() == v.tolist()
        assert [code.select(i) for i in range(n)] == v.tolist()
    seg = Segment(pack_segment([None, -5, 10**12], np.array([1, 0, 2]), np.array([7, 70000, 3])))
    assert seg.doc_ids() == [None, -5, 10**12]
    assert [seg.document(i).tolist() for i in range(3)] == [[7], [], [70000, 3]]


def test_token_store(spark, odd):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df in (docs(spark), odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()), key=lambda r: r[:2])
        start, want = 0, []
        for has, d, t in rows:
            ids = tok.encode(t, add_special_tokens=False).ids + [2]
            want.append((d if has else None, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
        got = [tuple(r) for r in token_store(df, path).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_store(odd.limit(0), path).count() == 0


def test_quality_counts(spark, odd):
    forest = train(docs(spark), spark.read.parquet(f"{SF}/labels.parquet"))
    for df in (docs(spark), odd):
        text = Counter()
        for r in df.collect():
            t = r.text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
            wordy = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            bad = len(w) < 10 or 100 * len(cover) > 20 * len(w)
            text[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(wordy) - len(set(wordy)), len(cover), bad] += 1
        got = score_documents(df, forest)
        assert Counter(tuple(r)[:7] for r in got.collect()) == text
        assert keep_documents(df, forest).count() == got.where("kept").count()
    assert keep_documents(odd.limit(0), None).columns == odd.columns
    assert train(odd, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_boosting_is_monotonic_and_learns():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(8 * x[:, 0] - 4 - 2 * np.sin(9 * x[:, 1])))).astype(float)
    forest = boosting.fit(x[:3000], y[:3000], [-1, 0, 0])
    held = forest.score(x[3000:])
    assert ((held > 0) == (y[3000:] > 0)).mean() > 0.75
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.6)])
    assert (np.diff(forest.score(grid)) <= 1e-12).all()


def test_dart_signatures_estimate_similarity():
    a, b = np.linspace(0.2, 6, 100), np.linspace(0.2, 6, 100)[::-1]
    e = np.r_[np.arange(100), np.arange(20, 120)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = DartSketch(4096).signatures(e, np.repeat([0, 1], 100), np.r_[a, b], 2)
    x, y = np.r_[a, np.zeros(20)], np.r_[np.zeros(20), b]
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def brute_classes(rows):
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in rows if (w := (t or "").split())}
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def test_near_duplicates(spark, odd):
    random.seed(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(120):  # a group of copies of all degrees, around the threshold
        w = list(base)
        for _ in range(random.randint(0, 9)):
            w[random.randrange(150)] = f"v{random.random()}"
        rows.append((d, " ".join(w)))
    for df in (docs(spark).select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string")):
        want = brute_classes([tuple(r) for r in df.collect()])
        assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == want
    got = {r.doc_id: r.class_id for r in near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 9: 9}
    kept = keep_first(odd)
    assert kept.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 7, 9]
    assert near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, depth = int(rng.integers(1, 80)), int(rng.integers(2, 60))
        text = rng.integers(0, int(rng.integers(1, 5)), n)
        order, share = suffix_order(text, depth, held=int(rng.integers(1, 20)), run=int(rng.integers(3, 30)))
        raw = bytes(text.tolist())
        keys = [raw[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        for k in range(1, n):
            same = next((j for j, (a, b) in enumerate(zip(keys[k - 1], keys[k])) if a != b), min(len(keys[k - 1]), len(keys[k])))
            assert share[k] == same


def test_suffix_dedup(spark, odd):
    random.seed(5)
    base = ["".join(random.choice("ab ") for _ in range(300)) for _ in range(3)]
    kinds = [
        lambda: "a" * random.randint(0, 200),
        lambda: "abc " * random.randint(1, 60),
        lambda: "é" * random.randint(0, 9) + random.choice(base)[random.randint(0, 200) :][:90],
        lambda: "".join(random.choice("xy") for _ in range(25)) * 6,
        lambda: base[0][:120] + str(random.random()) + base[1][50:170],
    ]
    rows = [(i * 3 - 20, random.choice(kinds)(), "c") for i in range(50)]
    rows += [(None, base[0], "n"), (500, None, "n"), (7, base[0], "d"), (7, base[0][:200], "d"), (501, base[0], "z")]
    made = spark.createDataFrame(rows, "doc_id long, text string, tie string")
    for df in (docs(spark).select("doc_id", "text"), made, odd):
        table = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        seen, want, left = {}, [], Counter()
        for d, b in table:
            for p in range(len(b) - 49):
                if d is not None:
                    seen[b[p : p + 50]] = min(d, seen.get(b[p : p + 50], d))
        for d, b in table:
            cover = np.zeros(len(b) + 1, int)
            for p in range(len(b) - 49):
                if d is not None and seen[b[p : p + 50]] < d:
                    cover[p] += 1
                    cover[p + 50] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.r_[0, gone.astype(int)]) > 0).sum())
            want.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            left[d, kept.decode("utf-8", "ignore") if gone.any() else None] += 1
        assert sorted(map(str, map(tuple, dedup_spans(df).collect()))) == sorted(map(str, want))
        out = remove_repeats(df)
        assert out.columns == df.columns
        assert out.count() == sum(n for (_, t), n in left.items() if t != "")
    assert dedup_spans(odd.limit(0)).count() == 0


def test_contaminated_by_long_items_and_several_texts(spark):
    parts = [" ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 40), ("b", 90), ("c", 17_000))]
    items = spark.createDataFrame([(1, parts[0]), (1, parts[1]), (2, parts[2])], "item_id long, text string")
    table = [(1, "x y " + parts[0] + " z"), (2, parts[1]), (3, parts[2]), (4, parts[0] + " " + parts[1]), (5, "none of them is here")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = sorted(tuple(r) for r in contaminated(df, items).collect())
    assert got == [(1, 1, 2, 1.0), (2, 1, 0, 1.0), (3, 2, 0, 1.0), (4, 1, 0, 1.0)]
    assert [r.doc_id for r in drop_contaminated(df, items).collect()] == [5]


def test_contaminated(spark, odd):
    items = spark.createDataFrame([(1, "gamma delta epsilon zeta eta theta iota"), (2, "two"), (3, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in contaminated(odd, items).collect())
    assert got == [(1, 1, 2, 1.0), (2, 1, 2, 1.0)]
    assert sorted(r.doc_id or 0 for r in drop_contaminated(odd, items).collect()) == [0, 3, 4, 5, 6, 7, 7, 9]
    assert contaminated(odd.limit(0), items).count() == 0 and contaminated(odd, items.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, t, "u" if t % 2 else "a", f"m{t}") for t in range(700)]
    rows += [(2, t, "u" if t % 2 else "a", f"m{t}") for t in range(300)]  # a snapshot of 1
    rows += [(3, 0, None, None), (4, 0, None, None), (4, 1, "u", "<|im_end|>"), (5, None, "u", "x"), (5, None, "u", "x"), (None, 0, "u", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = sorted((r.conv_id, r.part, r.n_turns, r.text) for r in render(maximal_conversations(turns)).collect())
    assert [r[:3] for r in out] == [(1, 0, 256), (1, 1, 256), (1, 2, 188), (4, 0, 2), (5, 0, 1)]
    assert out[3][3] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>u\n\\<|im_end|><|im_end|>\n"
    assert maximal_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("quote", ["'", '"'])
def test_extract_long_attributes(quote):
    text = "This is a sentence of the article that holds enough words to be kept as main text of the page."
    for n in (10, 30_000):
        inside = "<p>hidden words > " * n
        page = f"<article><p>{text}</p><div data-props={quote}{inside}{quote}><p>{text}</p></div></article>"
        assert [t for t in blocks(page)[0]] == [text, text]
    assert blocks("<p a='x>one<p>two")[0] == ["one", "two"]
    start = time.process_time()
    for piece in ("<a ='>' ", "<a ='>", "<b x=\">' =\"", "<p a=\"'>"):
        blocks(piece * 50_000)
    assert time.process_time() - start < 30


def test_extract_keeps_text_behind_letters_that_grow_in_lower_case():
    page = "<p>" + "İ" * 400 + " one</p><SCRIPT>var a = '<p>no</p>'</ſcript></Script><p>two</p><style>x</style><p>three</p>"
    assert blocks(page)[0] == ["İ" * 400 + " one", "two", "three"]


def test_extract(spark):
    page = "<nav><a>x</a></nav><article><h1>T &amp; t</h1><p>a\n b<br>c<p>d.<div class='comments'><p>no</p></div></article><footer>f</footer>"
    assert extract(page) == "T & t\na b c\nd."
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<article>" + "<p>w" * 5000), (4, "u", "<!-- <p>x")]
    got = main_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string"))
    assert Counter((r.page_id, r.n_chars) for r in got.collect()) == Counter([(1, 14), (1, 14), (2, 0), (3, 0), (None, 9999), (4, 0)])


def test_urls(spark):
    rows = [
        (1, "http://a.net/es/1", "<link rel='canonical' href='http://b.org/x'>"),
        (2, "https://b.org/x#f", None),
        (3, "http://c.org/y", '<meta http-equiv="refresh" content="0; url=http://b.org/x">'),
        (4, "http://d.com/z", "<link rel=canonical href=http://b.org/x>"),
        (5, None, None), (6, "nothing", ""), (7, "http://E.org/q", "<link rel=canonical href='/r'>"), (7, "http://E.org/q", None),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = Counter((r.page_id, r.host, r.rule, r.verdict) for r in judge_urls(pages, queries.URL_RULES).collect())
    assert got == Counter([
        (1, "a.net", "net/es/", "block"), (2, "b.org", None, "block"), (3, "c.org", None, "block"), (4, "d.com", "com/", "allow"),
        (5, "", None, "allow"), (6, "", None, "allow"), (7, "e.org", None, "allow"), (7, "e.org", None, "allow"),
    ])
    assert judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_sentencepiece(spark, odd):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = ["  a", "a  ", "a \n b", "\n", "𝔘 é ﬁ ½", "Hello  the\n\n a\tb <s> é ", "    x\n   y", "a" * 500, "<0x0A>", "ab\0cd"]
    for df in (docs(spark), odd, spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string")):
        coded = encode_documents(df, path)
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        assert Counter(str((r.doc_id, list(r.ids))) for r in coded.collect()) == Counter(str((d, sp.encode(t))) for d, t in texts)
        assert Counter(tuple(r) for r in decode_documents(coded, path).collect()) == Counter(texts)


def test_pseudo_likelihood(spark, odd):
    rng = np.random.default_rng(0)
    net = pseudo_lm.initial(np.full(32, 10.0), np.ones(1024))
    tokens, cut = rng.integers(0, 1024, 300), np.array([0, 100, 100, 300])
    near = pseudo_lm.contexts(tokens, cut)
    grad = pseudo_lm.gradient(net, near, tokens)
    for i in rng.integers(0, pseudo_lm.N_PARAMETERS, 8):
        step = np.zeros(pseudo_lm.N_PARAMETERS)
        step[i] = 1e-4
        loss = [-pseudo_lm.log_probabilities(pseudo_lm.Network(net.flat + s * step), near, tokens).mean() for s in (1, -1)]
        assert abs((loss[0] - loss[1]) / 2e-4 - grad[i]) < 1e-4
    got = pseudo_lm.pseudo_likelihood(docs(spark)).toPandas()
    words = Counter(w for r in docs(spark).collect() for w in r.text.split())
    n = sum(words.values())
    top = [c for _, c in words.most_common(pseudo_lm.KNOWN)]
    rest = n - sum(top)
    unigram = sum(c * np.log(c / n) for c in top) + (rest * np.log(rest / 32 / n) if rest else 0)
    assert got.n_tokens.sum() == n and got.log_likelihood.sum() > unigram
    odd_rows = {(r.doc_id, r.n_tokens) for r in pseudo_lm.pseudo_likelihood(odd).collect()}
    assert odd_rows == {(1, 14), (2, 14), (3, 0), (4, 0), (5, 2), (6, 2), (7, 3001), (None, 14), (9, 1)}
    assert pseudo_lm.pseudo_likelihood(odd.limit(0)).count() == 0


def test_every_word_has_its_own_probability(spark):
    assert pseudo_lm.classes_for(457_666) > pseudo_lm.CLASSES
    rare = Counter({f"w{i}": 1 + i % 3 for i in range(1500)})
    table = [(i, f"x{i} " * 5) for i in range(992)] + [(2000 + i, " ".join([w] * n)) for i, (w, n) in enumerate(rare.items())]
    table += [(None, None), (1, "")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in pseudo_lm._scored(df, 3, 0.05, 4096).collect()}
    hashes = pseudo_lm.word_hashes(*pseudo_lm.byte_buffer(pseudo_lm.pa.array(list(rare))))[0]
    bucket = dict(zip(rare, pseudo_lm._bucket(hashes, 32).tolist()))
    size = Counter()
    for w, n in rare.items():
        size[bucket[w]] += n
    for i, (w, n) in enumerate(rare.items()):
        assert got[2000 + i].share == pytest.approx(n * np.log(n / size[bucket[w]]))
    assert all(got[i].share == 0 for i in [*range(992), None])
    words = {r.doc_id: r for r in pseudo_lm.word_likelihood(df).collect()}
    assert len(words) == len(got) and words[None].per_token is None
    assert words[0].per_token > words[2000].per_token  # a word counted five times against one counted once


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_pieces"]
    table = docs(spark)
    forest = train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in score_documents(table, forest).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in table.collect() if r.doc_id in kept]
    first = {d for d, c in brute_classes(rows).items() if d == c}
    got = {r.doc_id for r in out.collect()}
    assert got <= first and len(got) > 0.7 * len(first)
