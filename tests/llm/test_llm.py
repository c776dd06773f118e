"""Training-data operators: against libraries and brute force, and on nulls, empties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from meterfold.llm import bpe, chat, decontamination, html_text, jaccard_join, quality_classifier, quality_rules, token_counts, token_files, toxicity
from meterfold.llm.common import dim_join, scratch
from meterfold.llm.groups import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [
    (0, None),
    (1, ""),
    (2, "  \n\t "),
    (3, "tiny"),
    (4, "don't  stop now　… \U0001f642é漢 <|endoftext|> ▁▁x"),
    (5, "a" * 3000 + " " + "the" * 400),
    (6, " ".join(WORDS * 3)),
    (6, " ".join(WORDS * 3)),
    (None, "null key " + " ".join(WORDS)),
    (7, "x\x1cy\x85z \x00 end"),
]
SCHEMA = "doc_id long, text string"
RANKS, JSON, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with more columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("key", "token_ids", "pieces", "node", "n_tokens", "score", "group_0", "own", "_salt", "_row", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(odd, none, docs):
    enc = tiktoken_encoding()
    for df in (odd, docs):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text or "")
        for r in bpe.round_trip(df, RANKS, P.PATTERN, ids=True).collect():
            text = texts[r.doc_id][0]
            assert r.token_ids == enc.encode_ordinary(text)
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest()
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_replay_on_random_pieces():
    enc, merges = tiktoken_encoding(), bpe.MergeReplay(bpe.read_ranks(RANKS))
    rng = np.random.default_rng(0)
    pieces = ["".join(rng.choice(list("aeinrst lhé漢-=")) for _ in range(n)) for n in rng.integers(1, 80, 800)] + ["aa" * 90, "ab" * 99]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.encode(pieces)] == [enc.encode_single_piece(p) if hasattr(enc, "encode_single_piece") else enc._encode_single_piece(p.encode()) for p in pieces]


def test_vocabulary_is_the_corpus(spark, docs):
    """The pieces that recur most, with the library's codes."""
    enc, counts = tiktoken_encoding(), defaultdict(int)
    import regex

    for r in docs.collect():
        for p in regex.findall(P.PATTERN, r.text or ""):
            counts[p] += 1
    got = bpe.vocabulary(docs, RANKS, P.PATTERN, head=300).collect()
    least = min(counts[r.piece] for r in got)
    assert 200 < len(got) <= 300 and {r.piece for r in got} == {p for p, n in counts.items() if n >= least}
    assert bpe.vocabulary(docs, RANKS, P.PATTERN, head=0).count() == 0 and bpe.vocabulary(docs, RANKS, P.PATTERN).count() == sum(n > 1 for n in counts.values())
    assert all(np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.piece) for r in got)


def test_remembered_codes_are_the_same_after_forgetting():
    from meterfold.llm.ragged import Remembered
    import pyarrow as pa

    seen = []

    def encode(words):
        seen.extend(words)
        return [np.arange(len(w), dtype="<u4").tobytes() for w in words]

    code, rng = Remembered(encode, limit=20, known=(pa.array(["stays"]), np.arange(5, dtype="<u4"), np.array([5]))), np.random.default_rng(5)
    for _ in range(60):
        words = pa.array(sorted({"w" * int(k) for k in rng.integers(0, 40, 12)} | {"stays", "often"}))
        got = code(words)
        for w, a, n in zip(words.to_pylist(), got.starts, got.lengths, strict=True):
            assert got.flat[a : a + n].tolist() == list(range(len(w)))
        assert len(code.pieces) <= 1 + 20 + len(words)
    assert "stays" not in seen and seen.count("often") == 1


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    folder = scratch(spark, "test-files")
    files = token_files.write(odd, JSON, P.PATTERN, folder)
    got = token_files.with_checksum(token_files.read(files, folder)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((k for k, _ in ODD), key=lambda k: -1 if k is None else k)
    start, texts = 0, {k: t or "" for k, t in ODD}
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read(files, folder, only=[4, 6]).collect()
    assert sorted(r.doc_id for r in some) == [4, 6, 6]
    folder = scratch(spark, "test-files")
    assert token_files.read(token_files.write(none, JSON, P.PATTERN, folder), folder).count() == 0


def test_equal_rows_are_split_over_files(spark):
    df = spark.createDataFrame([(None, "same words")] * 400 + [(5, "same words")] * 400, SCHEMA).repartition(8)
    folder, together = scratch(spark, "test-files"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(together, "false")
    try:
        files = token_files.write(df, JSON, P.PATTERN, folder)
    finally:
        spark.conf.unset(together)
    assert files.count() > 2 and files.selectExpr("max(n_docs)").first()[0] < 500
    rows = token_files.read(files, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 400 + [5] * 400 and rows[-1].start == sum(r.n_tokens for r in rows[:-1])
    with pytest.raises(ValueError):
        token_files.write(df.selectExpr("cast(doc_id as string) as doc_id", "text"), JSON, P.PATTERN, folder)


def test_damaged_frame_is_found(tmp_path):
    path = tmp_path / "x.zst"
    w = token_files.FileWriter(open(path, "wb"))
    for k in range(3):
        w.add(k, np.arange(50 + k, dtype="<u4").tobytes())
    w.close()
    import zstandard

    whole = b"".join(np.arange(50 + k, dtype="<u4").tobytes() for k in range(3))
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == whole
    raw = bytearray(path.read_bytes())
    raw[10] ^= 255
    path.write_bytes(raw)
    with open(path, "rb") as f:
        r = token_files.FileReader(f, len(raw))
        assert np.frombuffer(r.ids(2), "<u4").tolist() == list(range(52))
        with pytest.raises(Exception):  # noqa: B017
            r.ids(0)


def test_token_counts(odd, none, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (odd, docs):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in token_counts.count_tokens(df, MODEL, limit=100).collect():
            n = len(sp.encode(texts[r.doc_id]))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 100)
    assert token_counts.count_tokens(none, MODEL).count() == 0


def test_token_counts_of_long_sequences():
    import sentencepiece

    sp, merges = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.PieceMerges(MODEL)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("etaoinsrhé漢"), n)) for n in (159, 160, 161, 1000, 5000)] + ["a" * 1001, "=-" * 700, "the" * 900, "漢字" * 400, "0123456789" * 120, "x"]
    texts += ["".join(rng.choice(list("aeinrst-="), n)) for n in rng.integers(2, 60, 300)]
    assert merges.count([" " + t for t in texts]).tolist() == [len(sp.encode(t)) for t in texts]


def brute(docs):
    """Classes and links by comparing n-gram sets that share an n-gram."""
    sets, index = {}, defaultdict(list)
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        for g in sets[d]:
            index[g].append(d)
    links = defaultdict(set)
    for d, own in sets.items():
        for e in {e for g in own for e in index[g]} - {d}:
            both = len(own & sets[e])
            if both / (len(own) + len(sets[e]) - both) >= 0.8:
                links[d].add(e)
    out = {}
    for d in sorted(docs):
        if d not in out:
            todo, seen = [d], {d}
            while todo:
                for e in links[todo.pop()] - seen:
                    seen.add(e)
                    todo.append(e)
            out |= dict.fromkeys(seen, d)
    return {d: (out[d], len(links[d])) for d in docs}


@pytest.mark.parametrize("p", [jaccard_join.Params(), jaccard_join.Params(block_rows=3, block_shingles=500)])
def test_jaccard_join_is_brute_force(spark, docs, p):
    rng = np.random.default_rng(1)
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    base = [str(rng.choice(WORDS)) + str(rng.integers(50)) for _ in range(120)]
    for k in range(30):  # near copies of one text, each with words of its own
        own = list(base)
        for _ in range(k % 5):
            own[int(rng.integers(120))] = f"new{rng.integers(1000)}"
        texts[1000 + k] = " ".join(own)
    texts |= {2000: None, 2001: "", 2002: "two words", 2003: "two  words", 2004: " "}
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df, p).collect()}
    assert got == brute(texts)


def test_jaccard_join_on_odd_rows(odd, none):
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(odd).collect()]
    assert len(got) == len(ODD) and got.count((6, 6, 1)) == 2 and (0, 0, 0) in got and (None, None, 0) in got
    assert jaccard_join.jaccard_join(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(700).select((F.col("id") * 7919 % 701).alias("u"), ((F.col("id") + 1) * 7919 % 701).alias("v"))
    assert [r.component for r in components(edges).select("component").distinct().collect()] == [0]
    with pytest.raises(RuntimeError):
        components(edges, rounds=2)


def test_pruning_bounds():
    p = jaccard_join.Params()
    needs = dict(jaccard_join.least_matches(p))
    assert sorted(needs) == [26, 52, 78, 104] and all(0 < m < 0.8 * n for n, m in needs.items())


HTML = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;<b>bold</b>
 text<br>goes on<p>Second</p><aside>side</aside><form><input></form><script>"</p>"</script>
<section id="comments"><p>reader</p></section><ul><li>one<li>two</ul></article><footer>f</footer></body></html>"""


def test_html(spark):
    rows = [(1, "https://h.example/a", HTML), (2, None, None), (3, "nohost", ""), (4, "x", "<p>a<<b <!-- no end")]
    rows += [(10 + k, "http://H.example:80/", f"<body><div>Same banner</div><p>Own text of page {k}</p></body>") for k in range(6)]
    rows += [(30, "http://h.example/", "<body><div>Same banner</div><p>Own text of page 0</p></body>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(1))).collect()}
    assert got[1].text == "Title & more\n\nFirst bold text goes on\n\nSecond\n\none\n\ntwo" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == "a<<b"
    assert all(got[10 + k].text == f"Own text of page {k}" for k in range(6)) and got[30].text == "Own text of page 0"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def html_of(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def prose(rng, n=40):
    return " ".join(rng.choice(WORDS, n)) + f" {rng.integers(1 << 30)}"


def test_html_templates_alone_give_the_text(spark):
    """Pages without article, and with nothing that names its unwanted parts: the site's recurring blocks go from each, rotating ones too."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(60):
        own = [prose(rng) for _ in range(3)]
        top, turn = "<div><p>Welcome to our site</p><p>All you can read</p></div>", f"<section>Buy thing {k % 12} today</section>"
        rows.append((k, "https://h.example/x", f"<body>{top}<div><h2>{own[0]}</h2><p>{own[1]}</p>{turn}<p>{own[2]}</p></div><div>Written by the team of this site</div></body>"))
        want[k] = "\n\n".join(own)
    rows.append((100, "https://h.example/y", "<div><p>Welcome to our site</p><p>All you can read</p></div>Short one"))
    rows.append((101, "https://other.example/", rows[0][2]))
    got = html_of(spark, rows)
    assert {k: got[k] for k in want} == want and got[100] == "Short one"
    assert got[101].startswith("Welcome to our site\n\nAll you can read") and "Buy thing 0 today" in got[101]


def test_html_near_copies_are_no_template(spark):
    """Near copies of an article, in article elements or not, and exact ones keep what they share; so do quoted passages in articles."""
    rng = np.random.default_rng(8)
    body, rows, want = [prose(rng, 60) for _ in range(8)], [], {}
    for k in range(20):
        own = list(body)
        own[int(rng.integers(8))] += f" edited {k}"
        inner = f"<h1>Title {k}</h1>" + "".join(f"<div><p>{b}</p></div>" for b in own)
        rows.append((k, "https://h.example/a", f"<body><article>{inner}</article></body>" if k % 2 else f"<body><div>{inner}</div></body>"))
        rows.append((50 + k, "https://h.example/a", rows[0][2]))
        want[k] = "\n\n".join([f"Title {k}", *own])
        want[50 + k] = want[0]
    quoted = prose(rng, 30)
    for k in range(20):
        own = prose(rng, 60)
        rows.append((100 + k, "https://q.example/a", f"<article><p>{own}</p><p>{quoted}</p></article>"))
        want[100 + k] = f"{own}\n\n{quoted}"
    assert html_of(spark, rows) == want


def test_html_template_counts_are_brute_force(spark, sf_dir):
    pages = [(k, f"https://{'ab'[k % 2]}.example/", "".join(f"<div>block {j} of {k % 2}</div>" for j in range(6) if (k * 7 + j * 3) % 5 < 2) + f"<p>{'own words ' * (k % 9)}{k}</p>") for k in range(40)]
    found, own = defaultdict(set), {}
    for k, url, html in pages:
        blocks = html_text.subtrees(html_text.parse(html))
        own[k] = [(url, h, size) for _, h, size, _ in blocks]
        for _, h, _, _ in blocks:
            found[url, h].add(k)
    shared = {k: sum(size for url, h, size in b if len(found[url, h]) >= 5) for k, b in own.items()}
    voters = {k for k, b in own.items() if 2 * shared[k] <= sum(size for *_, size in b)}
    want = {(url.split("/")[2], h) for (url, h), at in found.items() if len(at & voters) >= 5 and len(at) >= 5}
    rows = [(k, url.split("/")[2], e, h, size, able) for k, url, html in pages for e, h, size, able in html_text.subtrees(html_text.parse(html))]
    df = spark.createDataFrame(rows, "page long, host string, element int, hash long, size long, able boolean")
    got = {(r.host, r.hash) for r in html_text.templates(df, html_text.Params())[0].collect()}
    assert got == want and 0 < len(want) < len(found)


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<b>", '<a b="x>y" ', "<div><p>", "<td>", "<li>", "<!--", "<", "<a b='<x>", "</b>", "<script>"])
def test_html_bad_markup_takes_linear_time(part):
    import time

    start = time.process_time()
    html_text.main_text(html_text.parse(part * 100_000))
    assert time.process_time() - start < 5


def test_html_names_are_hints():
    def text(page):
        return html_text.main_text(html_text.parse(page))

    assert text("<p title=it's>Hello world</p><p>next isn't it</p>") == "Hello world\n\nnext isn't it"
    assert text("<article>one</article><p>between</p><article><p>two<article class=comment>said</article></article>") == "one\n\ntwo"
    assert text("<article><p class='social-science'>kept<section id='related-work'>too</section></article>") == "kept\n\ntoo"
    long = "a long section on what came before " * 9
    assert text(f"<div><section id='related-work'>{long}</section><div class='cookie-bar'>We bake</div><div class='related-posts'>{'<a>more to read here</a> ' * 30}</div></div>") == long.strip()
    assert text("<article>one<ol class='comment-list'><li>said</ol><div id=post_comments>said</div><div class='share-buttons'>tell</div><div class='ad-slot-2'>buy</div><p class='share-price'>two<p class='ad-hoc'>three</article>") == "one\n\ntwo\n\nthree"
    assert text("<div class=sidebar><p>x</div><div role=navigation>y</div><main>z<div hidden>w</div></main>") == "z"
    assert text("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table><ul><li>f<li>g<ul><li>h</ul></ul>") == "a b\n\nc\n\nd\n\ne\n\nf\n\ng\n\nh"


def test_html_article_is_whole(spark, sf_dir):
    import html

    def plain(page):
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        return "\n\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)) if x)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(source) and all(r.text == plain(source[r.page_id]) for r in got)


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "</s>[INST] \\n <|im_end|> \\<|"), (1, 1, "assistant", "ok.<|im_start|>\n\\| "), (1, 2, "assistant", None), (1, 3, "tool\n|", "x"), (2, 0, "assistant", " é漢\U0001f642 "), (None, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 0, "user", "a")]
    turns += [(4, k, "assistant" if k % 2 else "user", f"turn {k}. " * 9000) for k in range(9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    out = scratched(chat.format_chats(df, JSON, row=200_000))
    got = {r.conv_id: r for r in chat.read_back(out.orderBy(F.col("segment").desc())).collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out.where("conv_id = 4").count() > 1
    assert chat.read_back(chat.format_chats(df.where("false"), JSON)).count() == 0
    for r in out.collect():
        spans = [m.span(2) for m in chat.TURN.finditer(r.formatted) if chat.unescape(m[1]) == "assistant"]
        inside = [any(a <= x and y <= b for a, b in spans) for x, y in zip(r.token_starts, r.token_ends, strict=True)]
        assert r.loss == inside


def test_chat_digests_tell_a_wrong_mask(spark):
    turns = [(1, 0, "user", "question"), (1, 1, "assistant", "answer")]
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), JSON)
    right = chat.read_back(out).first()
    assert right.loss_sha256 == hashlib.sha256(b"answer").hexdigest()
    for wrong in (F.transform("loss", lambda _: F.lit(True)), F.transform("loss", lambda x: ~x), F.transform("loss", lambda x, i: x | (i == 0))):
        assert chat.read_back(out.withColumn("loss", wrong)).first().loss_sha256 != right.loss_sha256


def test_chat_rows_do_not_depend_on_partitions(spark):
    turns = [(c, k, "assistant" if k % 2 else "user", f"turn {k} of {c}. " * (3 * c)) for c in range(40) for k in range(c % 7 + 1)]
    turns += [(None, k // 2, "user", "hello " * k) for k in range(200)] + [(50, None, "assistant", "same")] * 300
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    adaptive, parts = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (2, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            for row in (chat.ROW, 5_000):
                seen.append(sorted(map(str, chat.format_chats(df.repartition(n), JSON, row=row).collect())))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(seen[0]) == 42 and seen[0] == seen[2] == seen[4]
    assert len(seen[1]) > 60 and seen[1] == seen[3] == seen[5]


def test_chat_pieces_join_to_what_one_encoding_gives(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f" turn {k}, \u6f22\U0001f642 <|im_end|> " * 9000) for k in range(12)]
    got = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), JSON).collect()
    text, spans = chat.render([(role, x) for _, _, role, x in turns])
    code = chat._tokenizer(JSON).encode(text, add_special_tokens=False)
    assert len(text) > 4 * chat.PIECE and len(got) == 1 and got[0].whole and got[0].formatted == text and got[0].n_turns == 12
    assert got[0].token_ids == code.ids and list(zip(got[0].token_starts, got[0].token_ends, strict=True)) == code.offsets
    mask = chat.loss_mask(*np.array(code.offsets).T, spans[1::2])
    assert got[0].loss == mask.tolist()


def test_chat_of_one_hot_conversation(spark):
    turns = [(7, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(3000)] + [(8, 0, "assistant", "b")]
    out = scratched(chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), JSON, row=500_000))
    assert out.where("conv_id = 7").count() > 2
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    loss = "".join(x for c, _, r, x in turns if c == 7 and r == "assistant")
    assert (got[7].n_turns, got[7].loss_sha256) == (3000, hashlib.sha256(loss.encode()).hexdigest()) and got[8].loss_chars == 1


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(odd, none, docs):
    files = MODEL, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    for df in (odd, docs):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = quality_rules.quality_rules(df, *files).collect()
        assert len(got) == df.count()
        for r in got:
            n = base_rules(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(none, *files).count() == 0


def de_bruijn(letters, width):
    """Words of letters in which no window of width letters comes twice."""
    seen, out = set(), [letters[0]] * (width - 1)
    while True:
        last = tuple(out[1 - width :])
        step = next((x for x in reversed(letters) if (*last, x) not in seen), None)
        if step is None:
            return out
        seen.add((*last, step))
        out.append(step)


def test_quality_bands_reject_junk(spark, docs):
    """Each band alone has a junk text that passes the base rules and lies outside; ordinary texts stay."""
    files = MODEL, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    plain = docs.where("lang = 'en'").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    said = " ".join(r.text or "" for r in plain.limit(20).collect()).split()
    some = [str(x) for x in rng.choice(said, 300)]
    junk = {
        "piece_chars": " ".join("".join(rng.choice(list("qxzjvkw"), 7)) for _ in range(300)),
        "byte_chars": " ".join(f"{w}{rng.choice(['$$$', '%%%', '***', '&&&'])}" for w in some),
        "fallback": " ".join(w + "".join(chr(0x10330 + int(k)) for k in rng.integers(0, 20, 2)) for w in some),
        "evenness": " ".join(de_bruijn(["the", "of", "and", "to"], 5)),
    }
    rows = spark.createDataFrame([(-1 - k, t, "en") for k, t in enumerate(junk.values())], "doc_id long, text string, lang string")
    p = quality_rules.Params()
    measured = scratched(quality_rules.measure(plain.unionByName(rows), *files))
    bands = scratched(quality_rules.bands(measured, p))
    open_band = F.struct(F.lit(0).alias("mid"), F.lit(0.0).alias("below"), F.lit(1e9).alias("above"))
    for k, name in enumerate(junk):
        only = bands.withColumns({f"{m}_band": open_band for m in quality_rules.METRICS if m != name})
        if name != "evenness":
            only = only.withColumn("evenness_sizes", F.lit(None).cast(bands.schema["evenness_sizes"].dataType))
        got = {r.doc_id: r for r in quality_rules.judge(measured, only, p).collect()}
        assert not got[-1 - k].base_failed and not got[-1 - k].fertile, name
        own = [r.fertile for d, r in got.items() if d >= 0 and not r.base_failed]
        assert np.mean(own) > 0.85, name


def scratched(df):
    path = scratch(df.sparkSession, "test")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_quality_bands_hold_against_a_hot_source(spark):
    """A fifth of a language is junk of one kind, part of it repeated lines; all of it goes and none of the rest does."""
    row = "n_words long, n_repeat_words long, n_tokens long, piece_chars double, byte_chars double, fallback double, evenness double"
    rows = [(k, "en", 300, 0, 600, 2.20 + k % 5 / 50, 2.22 + k % 5 / 50, 0.0, 0.70 + k % 3 / 100) for k in range(800)]
    rows += [(10_000 + k, "en", 300, 0, 600, 2.02, 1.69, 0.0, 0.68) for k in range(200)]
    rows += [(20_000 + k, "en", 300, 300, 600, 1.0, 1.0, 0.0, 0.1) for k in range(500)]
    measured = spark.createDataFrame(rows, f"doc_id long, lang string, {row}")
    p = quality_rules.Params()
    got = quality_rules.judge(measured, quality_rules.bands(measured, p), p).collect()
    assert all(r.kept == (r.doc_id < 10_000) for r in got)


def test_quality_bands_are_brute_force(spark, docs):
    """Bands and verdicts of all metrics by plain loops over the measured rows."""
    p, rng = quality_rules.Params(), np.random.default_rng(9)
    row = "n_words long, n_repeat_words long, n_tokens long, piece_chars double, byte_chars double, fallback double, evenness double"
    rows = [(k, "xy"[k % 2], int(rng.integers(5, 400)), int(rng.integers(0, 30)), int(2 ** rng.uniform(1, 10)), float(rng.gamma(4, 1)), float(rng.gamma(9, 0.5)) * (40 if k % 97 == 0 else 1), float(rng.beta(1, 30)), float(rng.beta(20, 4))) for k in range(900)]
    measured = spark.createDataFrame(rows, f"doc_id long, lang string, {row}")
    got = {r.doc_id: r.kept for r in quality_rules.judge(measured, quality_rules.bands(measured, p), p).collect()}

    def bin_of(metric, x):
        if not metric.endswith("chars"):
            return int(np.floor(x * p.bins))
        return int(np.floor(x * p.bins / 5)) if x <= 20 else 4 * p.bins + int(np.floor(4 * p.bins * np.log(x / 20)))

    names = [x.split()[0] for x in f"doc_id long, lang string, {row}".split(", ")]
    table = [dict(zip(names, r, strict=True)) for r in rows]
    for r in table:
        r["failed"] = r["n_words"] < p.min_words or 100 * r["n_repeat_words"] > p.max_repeat_percent * r["n_words"]
        r["size"] = int(np.floor(np.log2(max(1, r["n_tokens"]))))

    def band(some, metric):
        bins = sorted(bin_of(metric, r[metric]) for r in some)
        q = [bins[int(np.ceil(x * len(bins))) - 1] for x in (0.25, 0.5, 0.75)]
        unit = p.bins / 5 if metric.endswith("chars") else p.bins
        times, few = p.even_reach if metric == "evenness" else p.reach, np.sqrt(1 + p.enough / len(bins))
        return q[1], few * max(unit * p.least, times * (q[1] - q[0])), few * max(unit * p.least, times * (q[2] - q[1]))

    good, verdicts = [r for r in table if not r["failed"]], {}
    for r in table:
        own, wider, kept = [x for x in good if x["lang"] == r["lang"]], np.sqrt(1 + p.slack / max(1, r["n_tokens"])), not r["failed"]
        for m in quality_rules.METRICS:
            some = [x for x in own if x["size"] == r["size"]] if m == "evenness" else own
            mid, below, above = band(some if len(some) >= p.enough or m != "evenness" else own, m)
            off = bin_of(m, r[m]) - mid
            if m != "fallback" and off < -min(wider * below, mid / 2):
                kept = False
            if m != "evenness" and off > (wider * above if m.endswith("chars") else min(wider * above, (p.bins - mid) / 2)):
                kept = False
        verdicts[r["doc_id"]] = kept
    assert got == verdicts and 0 < sum(verdicts.values()) < len(good)


def test_quality_even_texts_need_their_own_length(spark):
    """An evenness that is usual for a long text is not for a short one."""
    row = "n_words long, n_repeat_words long, n_tokens long, piece_chars double, byte_chars double, fallback double, evenness double"
    rows = [(10 * n + k, "en", n, 0, n, 2.2, 2.2, 0.0, e) for n, e in ((100, 0.85), (3000, 0.58)) for k in range(9)] * 5
    rows.append((-1, "en", 100, 0, 100, 2.2, 2.2, 0.0, 0.58))
    measured = spark.createDataFrame(rows, f"doc_id long, lang string, {row}")
    p = quality_rules.Params()
    got = quality_rules.judge(measured, quality_rules.bands(measured, p), p).collect()
    assert all(r.kept == (r.doc_id >= 0) for r in got)


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1200):
        words, toxic = list(rng.choice(vocabulary, 30)), k % 8 == 0
        rows.append((k, " ".join([*words, *(["dreadful", "awful"] if toxic else [])])))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    own = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in own]) > 0.95
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert [r.score for r in toxicity.toxicity(docs, flipped).orderBy("doc_id").collect()] == [r.score for r in sorted(got, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_toxicity_slope_is_that_of_the_risk(shift):
    """By finite differences: of the whole risk, or against the second part where that is below zero."""
    rng = np.random.default_rng(3)
    z, n_p, prior = rng.normal(0, 1, 50), 12, 0.3
    z[12:] += shift
    first, second = toxicity.risk(z, n_p, prior)
    loss = lambda x: np.log(1 + np.exp(-x))
    assert np.isclose(first, prior * np.mean([loss(x) for x in z[:12]]))
    assert np.isclose(second, np.mean([loss(-x) for x in z[12:]]) - prior * np.mean([loss(-x) for x in z[:12]])) and (second < 0) == (shift < 0)
    for k in range(50):
        step = np.zeros(50)
        step[k] = 1e-6
        a, b = (np.array(toxicity.risk(z + d * step, n_p, prior)) for d in (1, -1))
        slope = (a - b) / 2e-6
        assert np.isclose(toxicity.risk_slope(z, n_p, prior)[k], slope.sum() if second >= 0 else -slope[1], atol=1e-6)


def test_toxicity_fits_one_row_a_key(spark):
    rows = [(k, f"plain words {k % 7} here") for k in range(60)] + [(3, "bad thing")] * 500
    labels = spark.createDataFrame([(k, int(k == 3)) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), labels)
    assert got.count() == len(rows) and got.where("score is null").count() == 0


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (6, 0), (None, 1), (99, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.toxicity(odd, labels.where("false")).collect())


def test_quality_on_labels(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_classifier.quality(docs, labels).join(labels, "doc_id")
    assert got.where((F.col("quality") == 1) & ~F.col("kept")).count() <= 0.02 * got.where("quality = 1").count()
    assert got.where("(quality = 1) = kept").count() > 0.95 * got.count()


def test_quality_on_held_out_labels(spark, sf_dir):
    """A model that saw half of the labels, on the other half."""
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality_classifier.quality(docs, labels.where(~unseen)).join(labels.where(unseen), "doc_id")
    assert got.where("quality = 1 AND NOT kept").count() <= 0.02 * got.where("quality = 1").count()
    assert got.where("(quality = 1) = kept").count() > 0.95 * got.count()


def test_posteriors_are_brute_force(spark):
    rng, p = np.random.default_rng(12), quality_classifier.Params()
    rows = [(k, f"h{rng.integers(6)}", f"p{rng.integers(3)}", int(rng.integers(1, 1_000_000))) for k in range(300)] + [(400, "alone", "p0", 500_000)]
    got = {r.key: r for r in quality_classifier.posteriors(spark.createDataFrame(rows, "key long, group_0 string, group_1 string, own long"), p).collect()}
    own = {k: x / 1e6 for k, _, _, x in rows}
    hosts, paths = defaultdict(list), defaultdict(list)
    for k, h, q, _ in rows:
        hosts[h].append(own[k])
        paths[h, q].append(own[k])
    mean = np.mean(list(own.values()))

    def strength(groups):
        n = np.array([len(g) for g in groups])
        d = sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups)
        between = (d - (len(n) - 1) * mean * (1 - mean)) / (n.sum() - (n**2).sum() / n.sum())
        return p.most_strength if between <= 0 else round(min(max(mean * (1 - mean) / between - 1, p.least_strength), p.most_strength), 3)

    k_host, k_path = strength(hosts.values()), strength(paths.values())
    for k, h, q, _ in rows:
        host = (k_host * mean + sum(hosts[h]) - own[k]) / (k_host + len(hosts[h]) - 1)
        path = (k_path * host + sum(paths[h, q]) - own[k]) / (k_path + len(paths[h, q]) - 1)
        path_odds = min(max(path, p.clip), 1 - p.clip)
        odds = own[k] / (1 - own[k]) * path_odds / (1 - path_odds) / (mean / (1 - mean))
        assert np.allclose([got[k].host_rate, got[k].path_rate, got[k].posterior], [host, path, odds / (1 + odds)])


def test_sites_pull_even_documents(spark):
    """Documents of even evidence follow their site; a site of one row follows the global rate."""
    rows = [(k, "bad", "", 50_000) for k in range(40)] + [(100 + k, "good", "", 950_000) for k in range(200)] + [(500, "bad", "", 500_000), (501, "good", "", 500_000), (502, "new", "", 500_000)]
    df = spark.createDataFrame(rows, "key long, group_0 string, group_1 string, own long")
    got = {r.key: r for r in quality_classifier.posteriors(df, quality_classifier.Params()).where("key >= 500").collect()}
    assert got[500].posterior < 0.5 < got[501].posterior and got[500].posterior < got[502].posterior <= got[501].posterior


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 1), (6, 1), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.quality(odd, labels).count() == len(ODD)
    assert quality_classifier.quality(odd, labels.where("false")).where("kept").count() == len(ODD)
    assert quality_classifier.quality(none, labels).count() == 0


def test_leaks(spark, odd, none):
    item = "If Maria has 12 apples and gives 5 apples to Peter, how many of the apples does Maria keep for the 3 days of her trip?"
    asked = "Noise before it. If Olga has 31 apples and gives 7 apples to Ivan, how many of the apples does Olga keep for the 9 days of her trip? And after."
    mixed = asked.replace("Olga keep", "Ivan keep")
    docs = spark.createDataFrame([(1, f"Some words. {item} More."), (2, asked), (3, mixed), (4, "nothing of the kind is in here at all, I say"), (5, None), (6, "the red fox jumps")], SCHEMA)
    items = spark.createDataFrame([(1, item), (2, None), (3, "a b"), (4, "The red fox jumps")], "item_id long, text string").withColumn("hash", F.lit(1))
    strict = decontamination.Params(consistent=0.9)
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, items, strict).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 4)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[2, 1].n_changed >= 4
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(docs, items.where("false")).count() == 0
    assert decontamination.leaks(odd, items).count() == 0


def test_leaks_judge_each_occurrence(spark):
    """A verbatim copy counts beside other questions of its template, and so do several copies with other values."""
    ask = "If {0} has {1} apples and gives {2} apples to {3}, how many of the apples does {0} keep for the {4} days of her trip?".format
    item = ask("Maria", 12, 5, "Peter", 3)
    others = [ask("Olga", 31, 7, "Ivan", 9), ask("Lena", 40, 8, "Karl", 2), ask("Anna", 77, 6, "Paul", 4)]
    moved = item.replace("gives 5 apples", "gladly gives 5 apples").replace(" does Maria", " then does Maria")
    twice = "Tom has 31 red apples in the box today. Ann has 45 red apples in the box today. Who has more of them now?"
    filler = "and then nothing else of note came up here for a while "
    texts = {1: f"{item} {others[0]}", 2: " ".join(others), 3: " ".join([*others, filler * 3, item, *others]), 4: others[0].replace("Olga keep", "Ivan keep") + " " + others[1].replace("Lena keep", "Karl keep"), 5: f"{filler}{moved} {others[2]}", 6: f"{filler}{twice} {filler}"}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    items = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, items, decontamination.Params(consistent=0.9, coverage=0.2)).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 2)}
    assert [got[k].verbatim for k in sorted(got)] == [True, False, True, True, True]
    usual = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 2)} <= usual


def test_leaks_find_whole_items_of_any_kind(spark):
    """Verbatim items without a template window, of any length and script, and after words that don't end a sentence."""
    whole = {1: "WHAT IS THE CAPITAL OF FRANCE", 2: "Compute 48 / 6 + 7", 3: "法国的首都是哪一座城市", 4: "What colour has the sky", 5: "xylograph", 6: "เมืองหลวงของฝรั่งเศสคือ", 7: "Where Do Old Grey Foxes Sleep When Cold Winter Rain Falls Down On Them"}
    docs = spark.createDataFrame([(k, f"前文 noise, Question: {t} and more") for k, t in whole.items()] + [(30, "城市的首都是哪一座法国 compute 48 / 7 + 6 and what is the capital of spain"), (31, f"这里{whole[3]}呢"), (32, "question: what colour has the sky")], SCHEMA)
    items = spark.createDataFrame([*whole.items(), (8, "..."), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, items).collect()}
    assert set(got) == {(k, k) for k in whole} | {(31, 3), (32, 4)} and all(r.verbatim for r in got.values())


ASKED = {
    "en": ["If {0} buys {1} apples and {2} gives away {3} of them each day, after how many days does {0} have no apples left in the basket?", "A train leaves {0} at {1} and travels {2} km to {4}, how long does the whole journey take if it stops for {3} minutes on the way?", "The shop of {0} sells {1} lamps for {2} dollars each and {3} chairs at half of that price, what does it earn in all?"],
    "de": ["Wenn {0} heute {1} rote Bücher kauft und {2} davon {3} an die alte Schule verschenkt, wie viele bleiben ihr dann noch für den nächsten Tag übrig?", "Ein Zug fährt um {1} Uhr in {0} los und legt {2} km bis nach {4} zurück, wie lange dauert die ganze Fahrt, wenn er {3} Minuten unterwegs hält?", "Im Laden von {0} kosten {1} kleine Lampen zusammen {2} Euro und {3} große Stühle halb so viel, was nimmt er damit insgesamt ein?"],
    "fr": ["Si {0} achète {1} pommes et que {2} en donne {3} chaque jour, après combien de jours ne reste-t-il plus de pommes dans le panier ?", "Un train part de {0} à {1} heures et parcourt {2} km jusqu'à {4}, combien de temps dure le trajet entier s'il s'arrête {3} minutes en route ?", "La boutique de {0} vend {1} lampes à {2} euros chacune et {3} chaises à la moitié de ce prix, combien gagne-t-elle en tout ?"],
    "es": ["Si {0} compra {1} manzanas y {2} regala {3} de ellas cada día, ¿después de cuántos días no quedan manzanas en la cesta de la casa?", "Un tren sale de {0} a las {1} y recorre {2} km hasta {4}, ¿cuánto dura el viaje entero si se detiene {3} minutos en el camino?", "La tienda de {0} vende {1} lámparas a {2} euros cada una y {3} sillas a la mitad de ese precio, ¿cuánto gana en total?"],
}


def test_leaks_find_asked_again(spark):
    """Items with other names and numbers, in four languages: nine of ten are found, and none where the same value stands for two."""
    names, numbers = ["Olga", "Ivan", "Lena", "Karl", "Porto", "Basel", "Riga"], [7, 31, 45, 12, 90, 8, 64, 23]
    items, docs, rng = [], [], np.random.default_rng(1)
    for k, (lang, asked) in enumerate((lang, a) for lang, some in ASKED.items() for a in some):
        fill = lambda: [*(str(x) for x in (rng.choice(names[:4]), *rng.choice(numbers, 3, replace=False))), str(rng.choice(names[4:]))]
        items.append((k, asked.format("Maria", "15", "28", "4", "Lyon")))
        docs += [(100 * k + j, f"Something else before. {asked.format(*fill())} And after it.") for j in range(10)]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(d // 100 == i for d, i in got)
    for k, lang in enumerate(ASKED):
        assert sum((d, d // 100) in got for d, _ in docs if d // 300 == k) >= 27, lang


def test_leaks_tell_operators_apart(spark):
    items = spark.createDataFrame([(1, "Compute 48 / 6 + 7"), (2, "What is 12 + 7?"), (3, "Compute 3 times 4.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "now compute 48 / 6 + 7 at once"), (2, "compute 48 * 6 - 7"), (3, "so what is 12 + 7 then"), (4, "what is 12 - 7"), (5, "and compute 3 times 4 here"), (6, "12 + 7")], SCHEMA)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_leaks_of_shared_windows(spark):
    """Windows that all items share don't make candidates, and each document still gets its own item."""
    common = "please read the following short text with care and then answer the question that stands below it in one sentence"
    own = [" ".join(np.random.default_rng(k).choice(WORDS, 25)) for k in range(30)]
    items = spark.createDataFrame([(k, f"{common} {t}") for k, t in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{common} {own[k]} end") for k in range(30)] + [(100 + k, f"{common} nothing of these {k}") for k in range(50)], SCHEMA)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == {(k, k) for k in range(30)}


def test_leaks_are_the_benchmarks_passages(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts, known = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(d, i) for d, t in texts.items() for i, b in known.items() if b in t}


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr("meterfold.llm.common.is_small", lambda *a, **k: False)
    left = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = dim_join(left, dim, ["k"]).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"a": 34, "b": 33, None: 33}


def test_without_broadcasts_rows_are_the_same(spark, docs, sf_dir, monkeypatch):
    """Where no table is small enough: every join by shuffle, with salts."""
    items, labels, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels", "pages"))
    files = MODEL, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN

    def every():
        results = html_text.extract(pages), decontamination.leaks(docs, items), quality_classifier.quality(docs, labels), quality_rules.quality_rules(docs, *files), jaccard_join.jaccard_join(docs)
        return [sorted(map(repr, df.collect())) for df in results]

    usual = every()
    for module in ("common", "decontamination", "jaccard_join"):
        monkeypatch.setattr(f"meterfold.llm.{module}.is_small", lambda *a, **k: False)
    assert every() == usual
