"""Operators on documents against brute force, and the rows that every operator must stand."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquill.llm import decontam, huffman, langid, lines, minhash, mixing, privacy, quality, queries, token_files
from docquill.llm.common import connected_components, shared_dir, store
from tests_llm_rules import plain_hits, shingle_parts, shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7), (None, "one two", "en", "s", 7),
    (4, " \n\t", "fr", "", 3), (5, "é É <|endoftext|> don't \x1c İx ½ ﬁ é 日本語 12 '' !!", "fr", "t", 9), (6, "word " * 30_000, "en", "s", 150_000),
]


def frame(spark, rows):
    """Rows with extra columns named like the operators' own."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "n", "words", "keys", "grams", "kept", "host", "u", "v", "tokens", "score", "_id", "_words", "means", "spans", "email"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def noisy(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    make = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows, i = [], 0
    for size in (3, 8, 12, 20, 30, 60, 200, 700):
        base = make(size)
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06):
            text = base if not share else noisy(rng, base, share)
            rows.append((i, text, "en", "s", len(text)))
            i += 1
    for _ in range(20):
        text = make(rng.randrange(1, 200)) + " released under the open license by its kind authors"
        rows.append((i, text, "en", "s", len(text)))
        i += 1
    return rows


def test_near_duplicates_against_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, corpus)).collect()}
    sets = {r[0]: shingles(r[1]) for r in corpus}
    part = shingle_parts({r[0]: r[1] for r in corpus})
    assert got == {i: (len(s), part[i], part[i] == i) for i, s in sets.items()}


def test_near_duplicates_odd_rows(spark):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in minhash.near_duplicates(frame(spark, ODD)).collect())
    sets = {i: shingles(t) for i, t, *_ in ODD if i is not None}
    assert got == sorted((i or -1, len(shingles(t)), i or -1, True) for i, t, *_ in ODD)
    assert len(sets[6]) == 1
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_prefix_pairs_need_no_shared_bands(spark, monkeypatch):
    """Sets of 25 to 34 shingles that a prefix key proposes are confirmed, however few bins agree."""
    monkeypatch.setattr(minhash, "AGREE", minhash.BINS + 1)
    w = [f"a{k}" for k in range(36)]
    rows = [(1, " ".join(w[:34]), "en", "s", 0), (2, " ".join(w[2:]), "en", "s", 0)]
    assert all(len(shingles(r[1])) == 30 for r in rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 1}


def test_crowded_buckets_are_settled(spark):
    """Texts that share a passage fill buckets without being alike; those among them that are alike are all found."""
    rng = random.Random(21)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for k in range(120):
        own = " ".join(f"o{rng.randrange(10**6)}" for _ in range(50))
        rows.append((2 * k, f"{own} {passage}", "en", "s", 0))
        if k % 6 == 0:  # its near copy, with an id far from it
            rows.append((10_000 + k, noisy(rng, f"{own} {passage}", 0.02), "en", "s", 0))
    rows += [(20_000 + k, f"{passage} {passage[:150]} x{k}", "en", "s", 0) for k in range(30)]  # mostly the passage
    part = shingle_parts({r[0]: r[1] for r in rows})
    for crowd in (8, minhash.CROWD, 10**9):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), crowd=crowd).collect()}
        assert got == part, crowd


def test_signature_filter_keeps_pairs_at_the_threshold(spark):
    """Random pairs at 0.7 agree in AGREE bins; pairs of texts that share a passage alone mostly don't."""
    def tags(n, common, side):
        run = lambda name, a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda j: F.xxhash64(F.lit(name), F.col("id"), j))
        sets = spark.range(0, 2000, 1, 4).select("id", F.sort_array(F.concat(run("both", 1, common), run(side, common + 1, n))).alias("grams"))
        return minhash._bands(sets, 70, 100).select("id", F.col("tags").alias(side))

    for n, common, low, high in ((34, 28, 1.0, 1.0), (300, 247, 1.0, 1.0), (300, 138, 0.0, 0.02)):  # similarities 0.7, 0.7, 0.3
        both = tags(n, common, "a").join(tags(n, common, "b"), "id")
        assert low <= both.agg(F.avg((minhash._agreeing(F.col("a"), F.col("b")) >= minhash.AGREE).cast("int"))).first()[0] <= high


def test_signature_is_consistent(spark):
    """Equal sets give equal keys, dense and sparse ones alike; each band is there."""
    rows = [(k, " ".join(f"a{j}" for j in range(n)), "en", "s", 0) for k, n in enumerate((30, 30, 90, 2000))]
    got = {r.id: r.keys for r in minhash._bands(minhash.shingle_sets(frame(spark, rows).select("doc_id", "text"), "doc_id", "text"), 70, 100).collect()}
    assert got[0] == got[1] and len(got[3]) == minhash.BANDS and len(got[2]) == minhash.BANDS


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (50, 60), (7, 7)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in connected_components(df, shared_dir(spark)).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in (50, 60, 100)} == {50}


def test_huffman():
    rng = np.random.default_rng(1)
    for ids in (np.empty(0, np.uint32), np.zeros(5, np.uint32), rng.zipf(1.3, 200_001).clip(0, 3000).astype(np.uint32), np.arange(70_000, dtype=np.uint32) % 257):
        counts = np.bincount(ids, minlength=4000)
        lengths = huffman.code_lengths(counts)
        assert lengths.max(initial=0) <= huffman.LIMIT and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        coded = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
        assert (huffman.decode(coded[0], len(ids), *coded[1:], lengths) == ids).all()
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert huffman.code_lengths(np.array(fib)).max() == huffman.LIMIT
    flat = huffman.code_lengths(np.array([5, 5, 5, 5]))
    assert (flat == 2).all()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(70_000), 16)
    for ids in (np.arange(300_000) % 100_000, rng.zipf(1.1, 300_000).clip(0, 250_000)):  # alphabets beyond 16 bits
        lengths = huffman.code_lengths(np.bincount(ids, minlength=250_001))
        assert huffman.LIMIT < huffman.width_of(lengths) <= 20
        coded = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
        assert (huffman.decode(coded[0], len(ids), *coded[1:], lengths) == ids).all()


def written(spark, df, name="word_bpe_49k.json", end=2, **more):
    folder = shared_dir(spark)
    token_files.write_token_files(df, folder, public_tokenizers.path(name), end, **more)
    return [r.asDict() for r in token_files.read_token_files(spark, folder).orderBy("start").collect()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["Hello World's ÀÉÎ ß don't 'sting !'s a1b22 <|endoftext|>x", "é ½ ª ﬁ ΑΣ Σ İ", "a\x0bb\x1cc d\x85e", "'''re 're x'll''ve", "", "\n", "ÿ×÷"]
    rows = [*ODD, *((10 + k, t, "en", "s", 0) for k, t in enumerate(texts))]
    got = written(spark, frame(spark, rows), name)
    want = sorted(((-1 if i is None else i, t or "") for i, t, *_ in rows))
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [i for i, _ in want]
    check_tokens(tok, got, want)
    # however small the files are, and however many rows share an id, rows and order stay
    many = [*rows, *((7, f"hot {k} " * (k % 5), "en", "s", 0) for k in range(60)), *((None, f"none {k}", "en", "s", 0) for k in range(20))]
    small, large = written(spark, frame(spark, many), name, file_tokens=50), written(spark, frame(spark, many), name)
    assert small == large and len(small) == len(many)
    assert written(spark, frame(spark, []), name) == []


def check_tokens(tok, got, want):
    start = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), ids.tobytes()), text[:50]
        assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_word_cache_limits(monkeypatch):
    monkeypatch.setattr(token_files, "WORD_LIMIT", 5)
    monkeypatch.setattr(token_files, "PIECE_LIMIT", 7)
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, tok, rng = token_files.WordEncoder(path), Tokenizer.from_file(path), random.Random(5)
    alphabet = "abÀé'’.,12 \n<|>st日½"
    for _ in range(40):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4)]
        ids, n = enc.encode([t.encode() for t in texts])
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(12)] + ["Éa", "x1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate((25, 14, 10, 9, 2, 40))] + [(6, None), (7, "..."), (None, "q r s"), (8, "Éa x1"), (8, "only this")]
    rows = list(ODD)
    for k in range(60):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(30)))
        if k % 3 == 0:
            text += ", " + rng.choice([t for _, t in items if t]).upper() + "! tail q-r s"
        rows.append((100 + k, text, "en", "s", 0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.decontaminate(frame(spark, rows), bench, cut=True).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i or -1, *plain_hits(t, items)) for i, t, *_ in rows)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_hit
        if r.n_hit:
            assert len(decontam.words_of(r.clean_text.encode())) <= r.n_words - r.n_hit + len(r.spans)
    assert sum(r.n_hit for r in decontam.decontaminate(frame(spark, rows), bench.limit(0)).collect()) == 0
    assert decontam.decontaminate(frame(spark, []), bench).count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    seq = rng.integers(1, 5, 400)
    seq[rng.integers(0, 400, 30)] = 0
    seq[-1] = 0
    index = decontam.FMIndex(seq, 9)
    for size in (1, 2, 3, 5):
        patterns = rng.integers(1, 10, (50, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [k for k in range(len(seq) - size + 1) if (seq[k : k + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN:
        own = []
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                own.append((*m.span(), m[0]))
        out[kind] = own
    return out


def test_personal_spans(spark):
    rng = random.Random(8)
    texts = ["a@b.co_x@d.ee, me@x..y b@c.d.e@f.g", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567. +12 345", "é😀 x@y.zz 10.0.0.1", "9" * 5000, "a" * 5000, "+" * 50 + "1" * 20]
    texts += ["".join(rng.choice("01239 -.+()@ab_é") for _ in range(rng.randrange(120))) for _ in range(300)]
    rows = [*ODD, *((10 + k, t, "en", "s", 0) for k, t in enumerate(texts))]
    got = privacy.find_personal(frame(spark, rows)).collect()
    have = sorted((r.doc_id or -1, *(tuple((s.start, s.stop, s.value) for s in r[k]) for k, _ in PLAIN)) for r in got)
    assert have == sorted((i or -1, *(tuple(plain_spans(t)[k]) for k, _ in PLAIN)) for i, t, *_ in rows)
    assert privacy.find_personal(frame(spark, [])).count() == 0


def test_disclosing_terms(spark):
    rows = [(k, f"write to Mallory at m@x.org about the usual thing, says MALLORY number {k}", "en", "s", 0) for k in range(4)]
    rows += [(10 + k, f"the usual thing about other people, item{'abcdefgh'[k % 8]}", "en", "s", 0) for k in range(60)]
    got = {r.doc_id: r for r in privacy.find_personal(frame(spark, rows)).collect()}
    text = rows[0][1]
    assert {text[s.start : s.stop].lower() for s in got[0].term} >= {"mallory", "write"} and all(text[s.start : s.stop].lower() != "usual" for s in got[0].term)
    assert all(not r.term for i, r in got.items() if i >= 10)
    spans = [(s.start, s.stop, "email") for s in got[0].email] + [(s.start, s.stop, s.value) for s in got[0].term]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start: bigint, stop: bigint, kind: string>>")
    clean = df.select(privacy.sanitised(F.col("text"), F.col("spans")).alias("t")).first().t
    assert "m@x.org" not in clean and "<EMAIL>" in clean and "allory" not in clean.lower() and "usual thing" in clean


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{k}@h{k % 7}.example.org é 10.0.{k % 256}.{k // 256}" for k in range(3000))
    row = privacy.find_personal(frame(spark, [(1, text, "en", "s", 0)])).first()
    for kind in ("email", "ip"):
        assert [(s.start, s.stop, s.value) for s in row[kind]] == plain_spans(text)[kind]


def test_term_spans_against_brute_force(spark):
    rng = random.Random(31)
    vocab = [f"v{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    people = [f"p{k}@x.org" for k in range(25)]
    rows = []
    for k in range(160):
        words = rng.choices(vocab, [1 / (j + 1) for j in range(100)], k=rng.randrange(1, 25))
        if k % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), people[min(rng.randrange(25), rng.randrange(25))])
        if k % 9 == 0:
            words += ["+49 30 1234567", people[3]]
        rows.append((k, " ".join(words), "en", "s", 0))
    entity, terms, n = {}, {}, len(rows)
    for i, t, *_ in rows:
        for kind, spans in plain_spans(t).items():
            for s in spans:
                entity.setdefault((kind, s[2].lower()), set()).add(i)
        for w in set(re.findall("[a-z]+", re.sub(PLAIN[0][1], " ", t))):
            terms.setdefault(w, set()).add(i)
    want = {}
    for docs in entity.values():
        for w, there in terms.items():
            both, ne, nt = len(docs & there), len(docs), len(there)
            if both and ne < n:
                share = np.log2((both + ne / n) / (nt + 1) * n / ne) / np.log2(n / ne)
                if share >= 0.45:
                    for i in docs & there:
                        want[i, w] = max(share, want.get((i, w), 0))
    got = {}
    for r in privacy.find_personal(frame(spark, rows), generalise=0.45, remove_at=0.7).collect():
        for s in r.term:
            got[r.doc_id, rows[r.doc_id][1][s.start : s.stop].lower()] = s.value
    assert len(want) > 20 and got == {k: "removed" if v >= 0.7 else "general" for k, v in want.items()} and len(set(got.values())) == 2


def test_entities_of_few_documents_disclose(spark):
    """Values in one or two documents have terms too, short names as well; what is common elsewhere stays."""
    rows = [(0, "ask Bo Quist at b@x.org about the usual thing", "en", "s", 0)]
    rows += [(k, "call Al Zorn on +1 555 123 4567 about the usual thing", "en", "s", 0) for k in (1, 2)]
    rows += [(10 + k, "the usual thing about other people, ask or call at noon on friday", "en", "s", 0) for k in range(400)]
    got = {r.doc_id: {rows[r.doc_id][1][s.start : s.stop].lower(): s.value for s in r.term} for r in privacy.find_personal(frame(spark, rows)).collect() if r.doc_id < 10}
    share = lambda both, nt, ne, n=403: np.log2((both + ne / n) / (nt + 1) * n / ne) / np.log2(n / ne)
    assert privacy.GENERALISE <= share(1, 1, 1) < privacy.REMOVE and privacy.GENERALISE <= share(2, 2, 2) < privacy.REMOVE
    assert got == {0: {"bo": "general", "quist": "general"}, 1: {"al": "general", "zorn": "general"}, 2: {"al": "general", "zorn": "general"}}


def test_line_dedup(spark):
    page = lambda k: f"<html><head><title>t</title><style>x</style></head><body><nav>Home</nav><!-- no --><p>Page {k} &amp; more</p><script>y</script><footer>Foot</footer></body></html>"
    rows = [(k, f"http://A.example.org:80/{k}", page(k)) for k in range(10)] + [(20, "https://u@b.example.org", page(1)), (21, None, page(2)), (22, "nonsense", None), (20, "https://b.example.org/x", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("lines", F.lit(1))
    got = {(r.page_id, r.n_lines): r for r in lines.drop_boilerplate(df).collect()}
    assert got[3, 3].clean_text == "Page 3 & more" and got[3, 3].n_dropped == 2 and got[3, 3].host == "a.example.org"
    assert got[20, 3].n_dropped == 0 and got[21, 3].n_dropped == 0 and got[22, 0].clean_text == ""
    assert len(got) == 14 and lines.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_of_long_and_broken_pages(spark):
    """Openers without an end, lines of a megabyte and thousands of lines: passed in one go, each with a defined text."""
    pages = ["<!-- " * 20_000 + "<p>seen?", "<p>a</p>" + "<script>" * 20_000, "<p>" + "x" * 1_000_000, "".join(f"<p>line {k % 3_000}</p>" for k in range(6_000)), "<p>open <b", "a < b > c & d", "<style>p", "\0\r\n\t"]
    df = spark.createDataFrame([(k, f"http://h.org/{k}", p) for k, p in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in lines.drop_boilerplate(df).collect()}
    assert [got[k].n_lines for k in range(8)] == [0, 1, 1, 6_000, 1, 1, 0, 1] and all(r.n_dropped == 0 for r in got.values())
    hot = spark.createDataFrame([(k, "http://h.org/", "<p>same</p>" * 3 + f"<p>own {k}</p>") for k in range(50)], "page_id bigint, url string, html string")
    assert all(r.clean_text == f"own {r.page_id}" and r.n_dropped == 3 for r in lines.drop_boilerplate(hot).collect())


def test_quality_of_odd_tables(spark):
    docs, none = frame(spark, ODD), spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit_on(frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert model.rules == () and quality.scored(frame(spark, []), model).count() == 0
    assert all(r.score == pytest.approx(0.5) for r in quality.scored(docs, quality.fit_on(docs, none)).collect())
    again = frame(spark, [ODD[2]] * 30)
    assert quality.fit_on(again, spark.createDataFrame([(3, 1)] * 5, "doc_id bigint, quality int"), sample_rows=7).rules == ()


def test_languages(spark):
    words = {"en": "the and of that with this from have", "de": "der die und das nicht mit auf eine", "fr": "les des une est dans pour que avec"}
    rng = random.Random(6)
    rows = [(k * 10 + j, " ".join(rng.choice(words[lang].split()) for _ in range(40)), lang, f"h{j % 3}.example.{lang}", 0) for j, lang in enumerate(words) for k in range(1, 40)]
    rows += [(5001, " ".join(words["de"].split() * 3), "en", "h0.example.de", 0), (5002, "12 34 !!", "en", "h", 0), *((6000 + i if i else None, *r) for i, *r in ODD)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    assert all(got[r[0]].lang == r[2] and got[r[0]].accepted for r in rows[: 39 * 3])
    assert got[5001].lang == "de" and not got[5002].accepted and got[5002].score == 0
    assert not got[6001].accepted and not got[6004].accepted and len(got) == 39 * 3 + 2 + 7
    assert not any(r.accepted for r in langid.identify(frame(spark, ODD).withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify(frame(spark, [])).count() == 0
    assert all(r.accepted == (r.lang == "fr") for r in langid.identify(frame(spark, rows[: 39 * 3]), accept=("fr",)).collect())
    html = spark.createDataFrame([('<!DOCTYPE html><HTML class="x" lang="fr-CA"><p>',)], "h string")
    assert html.select(langid.primary(langid.markup_language(F.col("h"))).alias("x")).first().x == "fr"


def plain_languages(rows, smooth=20.0, weight=40.0):
    """The fusion of evidence in plain Python, over (id, text, declared, host): {id: (lang, score)}."""
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (t or "").encode())
    bucket = lambda a, b, c: ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16

    def grams(t):
        t = b" " + fold(t) + b" "
        return [bucket(*t[k : k + 3]) for k in range(len(t) - 2) if t[k + 1] != 32]

    langs = sorted({d for _, _, d, _ in rows if d and sum(x[2] == d for x in rows) >= 5})
    counts, single = {x: Counter() for x in langs}, Counter()
    for _, t, d, _ in rows:
        if d in langs:
            counts[d].update(grams(t))
            single.update(fold(t))
    like = {x: lambda g, c=counts[x]: math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * 2**16)) for x in langs}
    used = sorted({32, *range(97, 123), *range(128, 256)})
    share = {b: (single[b] + 0.5) / sum(single[x] + 0.5 for x in used) for b in used}
    chance = Counter()
    for a in used:
        for b in used:
            if b != 32:
                for c in used:
                    chance[bucket(a, b, c)] += share[a] * share[b] * share[c]
    whole = sum(chance.values())
    unknown = lambda g: math.log(max(chance[g] / whole, 2**-16))
    means, guess, n = {}, {}, {}
    for i, t, _, _ in rows:
        g = grams(t)
        n[i] = len(g)
        if g:
            means[i] = {x: sum(map(like[x], g)) / len(g) for x in langs}
            best = max(langs, key=lambda x: means[i][x])
            if means[i][best] >= sum(map(unknown, g)) / len(g):
                guess[i] = best
    total = Counter(guess.values())
    overall = {x: (total[x] + 1) / (len(guess) + len(langs)) for x in langs}
    said = Counter((d, guess[i]) for i, _, d, _ in rows if d in langs and i in guess)
    claim = lambda d, x: math.log((said[d, x] + 1) / (sum(said[e, x] for e in langs) + len(langs))) if d in langs else 0.0
    def known_at(key, of):
        return Counter(guess[i] for i, _, _, h in rows if i in guess and h and of(h) == key)
    site_of, suffix_of = (lambda h: ".".join(h.split(".")[-2:]) if "." in h else None), (lambda h: h.split(".")[-1] if "." in h else None)
    smoothed = lambda c, parent, x: (c[x] + smooth * parent[x]) / (sum(c.values()) + smooth)
    out = {}
    for i, _, d, h in rows:
        if i not in guess:
            out[i] = (None, 0.0)
            continue
        logs = {}
        for x in langs:
            prior, suffix = overall, 0.0
            if h and site_of(h):
                at = known_at(site_of(h), site_of)
                prior = {y: smoothed(at, prior, y) for y in langs}
                suffix = math.log((known_at(suffix_of(h), suffix_of)[x] + smooth * overall[x]) / (total[x] + smooth))
            if h:
                at = known_at(h, lambda y: y)
                prior = {y: smoothed(at, prior, y) for y in langs}
            logs[x] = min(n[i], weight) * means[i][x] + claim(d, x) + suffix + math.log(prior[x])
        best = max(langs, key=lambda x: logs[x])
        out[i] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    return out


def test_languages_against_brute_force(spark):
    """Every kind of evidence, and rows in which each decides: hosts with a site and without, wrong, rare and missing declarations."""
    words = {"en": "the and of that with this from have", "de": "der die und das nicht mit auf eine", "es": "los las una con para que por está"}
    rng = random.Random(41)
    rows = []
    for k in range(150):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang].split()) for _ in range(rng.choice((1, 2, 8))))
        declared = rng.choice([lang] * 6 + ["de", None, "xx" if k % 50 == 0 else lang])
        rows.append((k, text, declared, rng.choice([f"w{k % 3}.site-{lang}.{lang}", f"w.site-{lang}.org", lang, None])))
    rows += [(500, "d o a", "en", "w0.site-de.de"), (501, "o e", None, "w0.site-es.es"), (502, "a", "de", "es"), (503, "12", "en", None), (504, None, None, None), (505, "Жук в лесу", "en", "en")]
    docs = frame(spark, [(i, t, d, h, 0) for i, t, d, h in rows])
    got = {r.doc_id: (r.lang, r.score) for r in langid.identify(docs).collect()}
    want = plain_languages(rows)
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)
    text_alone = plain_languages([(i, t, d, None) for i, t, d, _ in rows])
    assert any(text_alone[i][0] != x for i, (x, _) in want.items())  # hosts change a verdict


FOREIGN = (
    "Это обычный русский текст о погоде и людях, которые живут в большом городе", "これは普通の日本語の文章で、天気について書いてあります", "Жук",
    "To jest zwykły polski tekst o pogodzie i ludziach, którzy mieszkają w dużym mieście i często jeżdżą pociągiem",
    "c2Vjb25kIHF1aXogd3h6IEtKSEdGRFNBIHBvaXV5dHJld3EgbW5idmN4eiBaWFFXIHF3ZXJ0eXVpb3AgMTIzNDU2Nzg5MCBLTE1OT1BRUlNUVVZXWFla", "bxzq wrtk pfgh vjkl zzxc qwrt mnbv xkcd",
)


def test_languages_reject_unknown_text(spark):
    """Foreign and junk texts, short and long, are rejected whatever they declare; all others stay."""
    words = {"en": "the and of that with this from have", "de": "der die und das nicht mit auf eine", "es": "los las una con para que por está"}
    rng = random.Random(16)
    rows = [(k * 10 + j, " ".join(rng.choice(words[lang].split()) for _ in range(rng.choice((3, 40)))), lang, f"h{j}.example.{lang}", 0) for j, lang in enumerate(words) for k in range(60)]
    planted = [(9000 + 2 * k + far, t * (200 if far else 1), "es", "h2.example.es", 0) for k, t in enumerate(FOREIGN) for far in (0, 1)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(frame(spark, [(i, t, None, h, n) for i, t, _, h, n in planted]))).collect()}
    assert all(got[r[0]].lang == r[2] and got[r[0]].accepted for r in rows)
    assert all((got[r[0]].accepted, got[r[0]].lang, got[r[0]].score) == (False, None, 0) for r in planted)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_language_query_scores_pages(spark):
    """Each page gets a language from its own markup, host and text; documents keep the rows they have alone."""
    sf = "/root/testdata/sf0.001"
    got = queries.op5_language_id(spark, sf).collect()
    alone = langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {(r.doc_id, r.lang, round(r.score, 9), r.accepted) for r in got if r.page_id is None} == {(r.doc_id, r.lang, round(r.score, 9), r.accepted) for r in alone}
    pages = {r.page_id: re.search(r'<html[^>]* lang="?([a-z]+)', r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    own = {r.page_id: r for r in got if r.page_id is not None}
    assert set(own) == set(pages) and all(own[i].doc_id is None and own[i].declared == (m and m[1]) for i, m in pages.items())
    said = [i for i, m in pages.items() if m]
    assert sum(own[i].lang == pages[i][1] for i in said) > 0.7 * len(said) > 0


def test_quality(spark):
    rng = random.Random(9)
    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."
    rows, labels = [], []
    for k in range(600):
        text = prose(rng.randrange(5, 60))
        bad = k % 4 == 0
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w + "***" for w in text.split()), "again " * 30][k // 4 % 4]
        rows.append((k, text, "en", "s", 0))
        labels.append((k, None if k % 50 == 1 else int(not bad)))
    train = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id bigint, quality int")
    docs = frame(spark, rows)
    model = quality.fit_on(docs, train)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    held = [(got[i], q) for i, q in labels if i % 3 == 0 and q is not None]
    assert sum((s >= 0.3) == bool(q) for s, q in held) / len(held) > 0.97
    assert 1 < len(model.rules) < 200
    odd = quality.scored(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    alone = quality.fit_on(docs, train.where("quality = 1"))
    assert alone.rules == () and quality.scored(docs, quality.fit_on(docs, train.limit(0))).first().score == pytest.approx(0.5)
    assert len(quality.fit_on(docs, train, sample_rows=10).rules) >= 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, "tok " * rng.randrange(1, 40), rng.choice(["en", "en", "fr"]), rng.choice(["a", "a", "a", "b", "c"]), 0) for k in range(3000)]
    targets = {"source": {"a": 0.4, "b": 0.3, "c": 0.3, "gone": 1.0}, "lang": {"en": 0.5, "fr": 0.5}}
    out = mixing.mix(frame(spark, rows), targets=targets, keep=0.3).toPandas()
    w = out["weight"] * out["tokens"]
    assert w.sum() == pytest.approx(1) and w.groupby(out["source"]).sum().to_dict() == pytest.approx({"a": 0.4, "b": 0.3, "c": 0.3})
    assert w.groupby(out["lang"]).sum()["fr"] == pytest.approx(0.5)
    assert (out["prob"] * out["tokens"]).sum() == pytest.approx(0.3 * out["tokens"].sum())
    kept = out[out["kept"]]
    assert kept["tokens"].sum() / out["tokens"].sum() == pytest.approx(0.3, abs=0.05)
    again = mixing.mix(frame(spark, rows), targets=targets, keep=0.3, driver_cells=0).toPandas()
    both = out.merge(again, on="doc_id")
    assert np.allclose(both["weight_x"], both["weight_y"], rtol=1e-6) and np.allclose(both["prob_x"], both["prob_y"], atol=1e-6) and (both["kept_x"] == both["kept_y"]).mean() > 0.999
    odd = mixing.mix(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and any(r.source == "(none)" for r in odd) and mixing.mix(frame(spark, [])).count() == 0


@pytest.mark.parametrize("driver_cells", [mixing.DRIVER_CELLS, 0])
def test_mixing_meets_targets_in_the_sample(spark, driver_cells):
    """Production parameters, a source with a third of all tokens: expected shares of the sample equal the tempered targets."""
    rng = random.Random(12)
    tail = {"general": "", "tabular": " | a | b | c", "legal": " under the licence", "contact": " to a@b.org"}
    topics = rng.choices(list(tail), [90, 5, 4, 1], k=4000)
    rows = [(k, "tok " * rng.randrange(5, 60) + tail[t], rng.choices(["en", "de", "es"], [7, 2, 1])[0], "hot" if k % 3 == 0 else f"s{k % 11}", 0) for k, t in enumerate(topics)]
    out = mixing.mix(frame(spark, rows), driver_cells=driver_cells).toPandas()
    assert out["prob"].max() <= 1 and (out["prob"] == 1).any()
    sample, every = out["prob"] * out["tokens"], out["tokens"].sum()
    for d in mixing.DIMENSIONS:
        goal = mixing.targets_of(out.groupby(d)["tokens"].sum().to_dict(), None, mixing.TEMPER[d])
        assert (sample.groupby(out[d]).sum() / sample.sum()).to_dict() == pytest.approx(goal, abs=1e-4)
        assert (out["weight"] * out["tokens"]).groupby(out[d]).sum().to_dict() == pytest.approx(goal, abs=1e-4)
    limits = [out.loc[out[d] == v, "tokens"].sum() / every / s for d in mixing.DIMENSIONS for v, s in mixing.targets_of(out.groupby(d)["tokens"].sum().to_dict(), None, mixing.TEMPER[d]).items()]
    assert sample.sum() / every == pytest.approx(min(limits), rel=1e-3) and min(limits) < mixing.KEEP
    assert mixing.mix(frame(spark, [(1, "", "en", "a", 0), (2, None, "fr", "b", 0)]), driver_cells=driver_cells).where("prob <> 0").count() == 0


@pytest.mark.parametrize(("cells", "targets"), [
    ({("a", "en"): (10, 10), ("a", "fr"): (90, 10), ("b", "en"): (90, 10), ("b", "fr"): (10, 10)}, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.4}, "topic": None}),
    ({("a", "en"): (30, 7), ("a", "fr"): (20, 5), ("b", "en"): (50, 3), ("empty", "en"): (40, 0), ("b", "de"): (3, 11)}, None),
])
def test_mixing_is_the_same_on_the_driver_and_in_joins(spark, monkeypatch, cells, targets):
    """Targets of which only a smaller share can be kept, and a source without tokens: few rounds, every bit of every row equal."""
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    monkeypatch.setattr(mixing, "NEAR", 0.05)
    monkeypatch.setattr(mixing, "STEPS", 6)
    kinds = [(s, v, size) for (s, v), (n, size) in cells.items() for _ in range(n)]
    docs = frame(spark, [(k, "tok " * size, v, s, 0) for k, (s, v, size) in enumerate(kinds)])
    here, there = (sorted(mixing.mix(docs, targets=targets, driver_cells=n).collect()) for n in (mixing.DRIVER_CELLS, 0))
    assert len(here) == len(kinds) and here == there


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(8)
    x = [rng.random() * 2.0 ** rng.randrange(-60, 1) for _ in range(1000)]
    unit = mixing.unit_of(sum(x))
    sums = lambda v: float(mixing.exact_sums(np.zeros(len(v), np.int64), np.array(v), 1, unit)[0])
    assert sums(x) == sums(x[::-1]) == sums(sorted(x)) == pytest.approx(math.fsum(x), rel=1e-15)
    assert spark.createDataFrame([(v,) for v in x], "x double").repartition(3).agg(mixing.exact_sum(F.col("x"), unit)).first()[0] == sums(x)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_mixture_query_is_the_bounded_raking(spark):
    """Raking bounded at 1 has one solution: min(1, a product of one factor a value) that meets all shares. The query's rows are it."""
    out = queries.op7_mixture(spark, SF).toPandas()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(texts) and all(out["tokens"] == [len(re.findall(r"\S+", texts[i].text or "")) for i in out["doc_id"]])
    cells = out.groupby(list(mixing.DIMENSIONS)).agg(tokens=("tokens", "sum"), prob=("prob", "first"), spread=("prob", "nunique")).reset_index()
    assert (cells["spread"] == 1).all() and cells["prob"].between(0, 1).all()
    sample = (cells["prob"] * cells["tokens"]).sum()
    for d in mixing.DIMENSIONS:
        shares = cells.groupby(d)["tokens"].sum()
        goal = shares ** mixing.TEMPER[d] / (shares ** mixing.TEMPER[d]).sum()
        have = (cells["prob"] * cells["tokens"]).groupby(cells[d]).sum() / sample
        assert np.allclose(have, goal, atol=1e-4)
    some = cells[cells["tokens"] > 0]
    design = np.concatenate([(some[d].to_numpy()[:, None] == np.unique(some[d])[None]).astype(float) for d in mixing.DIMENSIONS], 1)
    free = (some["prob"] < 1 - 1e-9).to_numpy()
    logs = np.log(some["prob"].to_numpy())
    factors, *_ = np.linalg.lstsq(design[free], logs[free], rcond=None)
    assert np.abs(design[free] @ factors - logs[free]).max() < 1e-3  # a product of factors wherever the bound is not met
    row = spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(17), F.lit(int(i)).cast("bigint"), F.lit(texts[i].text or "")), F.lit(1 << 52)).alias(f"u{i}") for i in out["doc_id"][:50])).first()
    assert [bool(row[f"u{i}"] / 2**52 < p) for i, p in zip(out["doc_id"][:50], out["prob"][:50], strict=True)] == list(out["kept"][:50])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables aren't here")
def test_quality_query_on_held_out_labels(spark):
    """The driver's labels: rows of the held-out fold, which the fit never sees, against a guess of the larger class."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i], q) for i, q in labels.items() if got[i].held_out]
    right = sum(r.predicted == q for r, q in held) / len(held)
    good, bad = [r.score for r, q in held if q == 1], [r.score for r, q in held if q == 0]
    rank = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert right > 0.95 > max(len(good), len(bad)) / len(held) and rank > 0.98


def test_stores(spark):
    """s3a and s3n folders open as s3 with the session's settings, in tasks that have no session."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in (("fs.s3a.endpoint", "store.example:9000"), ("fs.s3a.access.key", "k"), ("fs.s3a.secret.key", "s"), ("fs.s3a.path.style.access", "true"), ("fs.s3a.connection.ssl.enabled", "false")):
        conf.set(key, value)
    try:
        for scheme in ("s3a", "s3n", "s3"):
            there = store(spark, f"{scheme}://bucket/a/b")
            assert there.options == {"endpoint_override": "store.example:9000", "access_key": "k", "secret_key": "s", "scheme": "http"}
            fs, path = cloudpickle.loads(cloudpickle.dumps(there)).open()
            assert fs.type_name == "s3" and path == "bucket/a/b"
    finally:
        for key in ("fs.s3a.endpoint", "fs.s3a.access.key", "fs.s3a.secret.key", "fs.s3a.path.style.access", "fs.s3a.connection.ssl.enabled"):
            conf.unset(key)
    folder = shared_dir(spark)
    there = store(spark, folder)
    there.make()
    there.put("x", b"one")
    there.put("x", b"two")
    assert there.get("x") == b"two" and store(spark, folder.removeprefix("file://")).get("x") == b"two"


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = ""

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,512]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session)


def test_work_folders_go(spark, corpus):
    """Operators leave their result behind, and nothing else."""
    base = os.path.dirname(store(spark, shared_dir(spark)).open()[1])
    docs = frame(spark, corpus)
    for run in (minhash.near_duplicates, langid.identify, mixing.mix, privacy.find_personal, lambda d: decontam.decontaminate(d, spark.createDataFrame([(1, "w1 w2")], "item_id int, text string"))):
        before = set(os.listdir(base)) if os.path.isdir(base) else set()
        run(docs).count()
        left = {x for x in os.listdir(base) if not x.startswith(".")} - before
        assert len(left) == 1 and left.pop().endswith("-out")
