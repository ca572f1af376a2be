import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paramloom.llm import catalog, exact_dedup, graph, line_dedup, mixing, near_dedup, packing, pieces, pii, quality, sharding, token_counts, url_filter
from paramloom.llm import scratch as scratch_module
from paramloom.llm.scratch import Scratch, as_stage
from tests.llm.helpers import CLASHES, SCHEMA, collected, empty, hard, hard_rows, words
from tests.oracle import check

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


# what every operator must survive

OPERATORS = {
    "pii": lambda s, d: pii.find_pii(s, d),
    "exact": lambda s, d: exact_dedup.exact_groups(s, d),
    "exact stage": exact_dedup.drop_copies,
    "tokens": lambda s, d: token_counts.count_tokens(s, d),
    "mixing": lambda s, d: mixing.weigh(s, d),
    "mixing stage": mixing.sample,
    "sharding": lambda s, d: sharding.shards(s, d),
    "packing": lambda s, d: packing.pack(s, d),
    "quality": lambda s, d: quality.judge(s, d),
    "quality stage": quality.filter_quality,
    "near": lambda s, d: near_dedup.near_groups(s, d),
    "near stage": near_dedup.keep_one,
    "lines": lambda s, d: line_dedup.repeated_runs(s, d),
    "lines stage": line_dedup.remove_repeats,
}
STAGES = [k for k in OPERATORS if "stage" in k]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_columns_change_nothing(spark, name):
    plain, clashing = OPERATORS[name](spark, hard(spark)), OPERATORS[name](spark, hard(spark, clashing=True))
    if name in STAGES:
        assert set(CLASHES) <= set(clashing.columns)
        assert all(r.row_id == "own row_id" and r.doc == "own doc" for r in clashing.select("row_id", "doc").collect())
    own = [c for c in plain.columns if c not in CLASHES or name not in STAGES]
    own = [c for c in own if c not in ("row_id", "group_size")]
    assert collected(plain, *own) == collected(clashing, *own)


# 1

def brute_base(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out["card"] = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


PII_TEXTS = [
    "a@b.cd@e.fg a.b+c@x-y.z.w_q@r.s", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (017) 555-7713 +1(((( +49-30-1234567.", "@@a@b@c.d", "é4111111111111111é x@y.z", "1" * 50, "12-" * 30, "",
]


def test_pii_base_spans(spark):
    import random

    rng = random.Random(4)
    texts = PII_TEXTS + ["".join(rng.choice("a1.@+- ()x2é") for _ in range(60)) for _ in range(1500)] + [r[1] or "" for r in hard_rows()]
    for text in texts:
        assert pii.base_spans(text) == brute_base(text), text


@needs_tables
def test_pii_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.QUERIES["op1_patterns_checksums"](spark, SF).collect():
        base = brute_base(docs[r.doc_id])
        assert [len(base[k]) for k in pii.BASE] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        order = sorted((s, i, k, e) for i, k in enumerate(pii.BASE) for s, e in base[k])
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in order)
        assert hashlib.sha256(text.encode()).hexdigest() == r.base_sha256
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pii_checksums_and_context():
    kinds = lambda t: [(k, t[s:e]) for k, s, e, _ in pii.all_spans(t)[1]]
    assert kinds("pay DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay DE88 3704 0044 0532 0130 00 now") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert kinds("commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff") == []
    assert kinds("call (017) 555-7713") == [("phone", "(017) 555-7713")] and kinds("part 017 555-7713") == []
    assert kinds("SSN 078-05-1120") == [("id", "078-05-1120")]


def test_pii_is_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "A1" * 150_000, "12 " * 100_000):
        pii.all_spans(text)


# 2

@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """weak: all blocks of a text of even length share a fingerprint, so names come from content."""
    options = {"block_bytes": 16, "fingerprint": (lambda b: F.octet_length(b).cast("long") % 2)} if weak else {}
    docs = hard(spark).filter("length(text) < 5000 or text is null") if weak else hard(spark)
    got = exact_dedup.exact_groups(spark, docs, **options).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == docs.count()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(by_sha, 1)


def test_exact_stage_keeps_the_largest_id(spark):
    kept = exact_dedup.drop_copies(spark, hard(spark))
    assert kept.columns == hard(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 1 not in ids and 2 in ids and ids[7] == 1 and 8 not in ids and 9 in ids


# 3

def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (300, 200)]
    got = dict(tuple(r) for r in graph.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert graph.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def page(i, url, canonical=None, refresh=None):
    html = "<html>" + (f'<link rel="canonical" href="{canonical}">' if canonical else "") + (f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else "")
    return (i, url, html)


def test_url_decisions_reach_aliases(spark):
    rows = [
        page(1, "http://www.a.com/en/1"), page(2, "https://a.com/xx", canonical="http://a.com/en/1/"), page(3, "http://Z.dev/y", refresh="https://a.com/xx#q"),
        page(4, "https://b.example.com/en/77"), page(5, "https://c.dev/", canonical="https://b.example.com/en/77?utm_source=x"),
        page(6, "https://c.dev", canonical="http://q.org/es/1"), page(7, None), page(8, "no-scheme/com/en/"), page(9, "http://x.example.net/de/8?a=1#b"),
        page(10, "http://example.net/de/9"), page(11, "http://notexample.com"), page(12, "http://d.dev/1"), page(12, "http://d.dev/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(spark, pages, spark.createDataFrame([("http://d.dev/1", "http://x.example.net/de/8?a=1")], "source string, target string")).collect()}
    verdicts = {k: r.verdict for k, r in got.items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "allow", 12: "block"}
    assert (got[3].host, got[3].path, got[3].rule) == ("z.dev", "/y", None)
    assert (got[4].rule, got[9].rule, got[10].rule) == ("example.com/en/7", "example.net/de/8", "net/de/")
    assert (got[7].host, got[8].path) == ("", "")
    assert url_filter.filter_urls(spark, pages.limit(0)).count() == 0
    extra = pages.withColumns({"node": F.lit(1), "alias": F.lit("x"), "rule": F.lit("y")})
    assert collected(url_filter.filter_urls(spark, extra), "page_id", "verdict") == collected(url_filter.filter_urls(spark, pages), "page_id", "verdict")


LINKS = [
    ('<link href="http://a.com/en/1" rel="canonical">', ["http://a.com/en/1"]), ("<LINK REL=Canonical HREF=http://a.com/en/1>", ["http://a.com/en/1"]),
    ("<meta content=\"0; URL='http://a.com/en/1'\" http-equiv='Refresh'/>", ["http://a.com/en/1"]), ('<meta http-equiv="refresh" content="5">', []),
    ("<link rel='next canonical'\nhref='/en/1?a=1&amp;b=2'>", ["http://a.com/en/1?a=1&b=2"]), ("<link rel=canonical href=//b.org/es/1>", ["http://b.org/es/1"]),
    ("<link rel=canonical href=1><link href=2 rel=canonical><meta http-equiv=refresh content='0;url=../3'>", ["http://a.com/x/1", "http://a.com/x/2", "http://a.com/3"]),
    ("<!-- <link rel=canonical href=1> --><script>'<link rel=canonical href=2>'</script><link rel=canonical href=3>", ["http://a.com/x/3"]),
    ('<base href="http://b.org/es/"><link rel="canonical" title="a > b" href="4">', ["http://b.org/es/4"]),
    ('<link rel="alternate" href="canonical"><links rel=canonical href=1><link rel="canonical">', []),
]


@pytest.mark.parametrize("html, want", LINKS)
def test_targets_of_a_page(html, want):
    assert url_filter.targets("http://a.com/x/y", html) == want


def test_targets_are_read_in_linear_time():
    for text in ("<link " * 100_000, "<!--" * 100_000, "<script>" * 100_000, "<link a=\"" * 50_000, "<link a='\" " * 50_000, "<meta" + " " * 300_000, "<link " + "a=" * 150_000):
        url_filter.targets("http://a.com/", text)


def test_url_decisions_reach_aliases_of_any_form(spark):
    rows = [(1, "http://a.com/en/1", ""), (2, "http://c.dev/2", '<link href="http://a.com/en/1" rel="canonical">'), (3, "http://c.dev/3", "<meta http-equiv=refresh content=\"0; url='http://a.com/en/1'\">"),
            (4, "http://c.dev/4", "<LINK REL=CANONICAL HREF=http://a.com/en/1>"), (5, "http://c.dev/5", "<link rel=canonical href=/2>"), (6, "http://c.dev/6", None)]
    got = url_filter.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


# 4, 7: tokens

def library(kind):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer() if kind == "byte" else packing.default_tokenizer())


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_pieces_equal_the_library(kind):
    import random

    tok = library(kind)
    enc = pieces.Encoder(tok.to_str(), kind)
    safe, rng = pieces._safe_chars(), random.Random(3)
    cases = [r[1] or "" for r in hard_rows()] + [f(c) for c in safe for f in (str, lambda c: f"a{c}b", lambda c: f" {c} 1", lambda c: f"1{c}{c}2", lambda c: f"'s{c}'S")]
    cases += ["".join(rng.choice(safe if rng.random() < 0.4 else " \n\t'aAbsSt1.!  ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    cases += ["x<|endoftext|> y<|startoftext|>", "日本語 テスト", "é", "\x1c a\x1d", "ﬁ İstanbul", "a" * 3000, ("ab  " * 3000)]
    for text, done in zip(cases, tok.encode_batch(cases, add_special_tokens=False)):
        assert enc.encode(text) == enc._raw(done.ids), repr(text[:60])


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_long_texts_are_cut_at_piece_ends(kind, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 50)
    tok = library(kind)
    enc = pieces.Encoder(tok.to_str(), kind)
    for text in (words(300, 1), "a   b\n\n" * 90, "x" * 500, " " * 300 + "a" * 300):
        assert enc.encode(text) == enc._raw(tok.encode(text, add_special_tokens=False).ids)


def test_token_counts_and_cache(spark, tmp_path):
    tok, cache = library("byte"), str(tmp_path / "cache")
    want = sorted(((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in hard_rows()), key=repr)
    docs = hard(spark)
    token_counts.count_tokens(spark, docs.filter("doc_id < 9"), cache_path=cache)
    first = spark.read.parquet(cache).count()
    assert first == len({r[1] or "" for r in hard_rows() if r[0] is not None and r[0] < 9})
    assert collected(token_counts.count_tokens(spark, docs, cache_path=cache), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in hard_rows()})
    token_counts.count_tokens(spark, docs, cache_path=cache)
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in hard_rows()})
    assert all(r.over_limit == (r.n_tokens > 1024) for r in token_counts.count_tokens(spark, docs, cache_path=cache).collect())


@needs_tables
def test_the_query_keeps_its_cache(spark):
    query, cache = catalog.QUERIES["op4_digest_cache"], token_counts.cache_of(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = collected(token_counts.count_tokens(spark, docs), "doc_id", "n_bytes", "n_tokens")
    for _ in range(2):
        assert collected(query(spark, SF), "doc_id", "n_bytes", "n_tokens") == want
        assert spark.read.parquet(cache).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def check_packing(rows, docs: list[tuple], capacity: int):
    tok = library("word")
    want = Counter()
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(doc, piece, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark):
    rows = packing.pack(spark, hard(spark)).collect()
    used, least = check_packing(rows, [(r[0], r[1]) for r in hard_rows()], 2048)
    assert used == least


@needs_tables
def test_packing_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(catalog.QUERIES["op7_configuration_lp"](spark, SF).collect(), docs, 2048)
    assert used <= least + 1


def test_packed_sequences_hold_the_ids(spark):
    docs = hard(spark).filter("doc_id < 8 or doc_id is null")
    rows = packing.pack(spark, docs, 64).collect()
    ids = {r.sequence_id: r.ids for r in packing.sequences(spark, docs, 64).collect()}
    for r in rows:
        part = ids[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r.ids_crc32
    assert sum(len(x) for x in ids.values()) == sum(r.length for r in rows)


def test_configurations_cover_the_histogram():
    import random

    rng = random.Random(2)
    for capacity, n in ((16, 40), (64, 500), (64, 20_000)):
        histogram = dict(Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(n)))
        chosen = packing.configurations(histogram, capacity)
        got = Counter()
        for config, times in chosen:
            assert sum(k * m for k, m in config.items()) <= capacity and times > 0
            for length, m in config.items():
                got[length] += m * times
        assert got == histogram
        least = -(-sum(k * v for k, v in histogram.items()) // capacity)
        assert sum(t for _, t in chosen) <= 1.02 * least + 1
    full = packing.configurations({6: 450, 5: 900}, 16)  # 5 + 5 + 6 fits exactly
    assert sum(t for _, t in full) == 450
    # twice as many sixes: two sixes and a five are 17, so the best is 450 of 5 + 5 + 6 and 225 of 6 + 6
    assert sum(t for _, t in packing.configurations({6: 900, 5: 900}, 16)) == 675
    assert packing.configurations({}, 16) == []


# 5

def test_raking_meets_its_targets(spark):
    rows = [(i, words(100, i), "en" if i % 3 else "de", f"s{0 if i % 4 else i % 8}", 1) for i in range(600)]
    got = mixing.weigh(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    expected = (got.n_tokens * got.probability).groupby(got.lang).sum()
    shares = got.groupby("lang").n_tokens.sum() / got.n_tokens.sum()
    goal = shares**0.7 / (shares**0.7).sum() * mixing.BUDGET * got.n_tokens.sum()
    assert ((expected - goal).abs() / goal).max() < 0.02
    assert abs(got[got.kept].n_tokens.sum() / got.n_tokens.sum() - mixing.BUDGET) < 0.06
    assert ((got.probability > 0) & (got.probability <= 1)).all()


def test_rows_of_one_id_draw_for_themselves(spark):
    rows = [(7, words(100, i), "en", "s0", 1) for i in range(400)]
    kept = mixing.sample(spark, spark.createDataFrame(rows, SCHEMA)).count()
    assert 140 < kept < 260  # a budget of one half


def test_raking_to_given_shares(spark):
    rows = [(i, words(100, i), ("en", "de", "fr")[i % 3], f"s{i % 2}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {"lang": {"en": 0.2, "de": 0.3, "fr": 0.5}, "source": {"s0": 0.6, "s1": 0.4}}
    cells = mixing.fit(spark, Scratch(spark, "t"), docs, targets=targets, budget=0.4).collect()
    all_ = sum(c.tokens * c.p for c in cells)
    assert all_ == pytest.approx(0.4 * sum(c.tokens for c in cells), rel=1e-6)
    for d, shares in targets.items():
        for value, share in shares.items():
            assert sum(c.tokens * c.p for c in cells if c[d] == value) == pytest.approx(share * all_, rel=1e-3)
    kept = Counter(r.lang for r in mixing.sample(spark, docs, targets=targets, budget=0.4).collect())
    assert kept["fr"] > kept["de"] > kept["en"] > 0
    some = mixing.fit(spark, Scratch(spark, "t"), docs, targets={"lang": {"fr": 0.0}}, budget=0.4).collect()
    assert all((c.p == 0) == (c.lang == "fr") for c in some)


def test_mixing_stage_agrees_with_the_report(spark):
    docs = spark.createDataFrame([(i, words(50, i), "en", f"s{i % 3}", 1) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = mixing.sample(spark, docs)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id") == collected(mixing.weigh(spark, docs).filter("kept"), "doc_id")


# 6

def test_hilbert_curve_is_continuous():
    import numpy as np

    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.indices((1 << bits,) * dims).reshape(dims, -1)
        h = sharding.hilbert_index(list(grid), bits)
        assert sorted(h) == list(range(len(h)))
        way = grid[:, np.argsort(h)]
        assert (np.abs(np.diff(way, axis=1)).sum(axis=0) == 1).all()


def check_shards(rows, texts: Counter):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    by = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    counts = [len(by.get(i, [])) for i in range(16)]
    assert max(counts) - min(counts) <= 1
    order = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def shard_key(doc, text):
    raw = (text or "").encode()
    return doc, len(raw) + 1, zlib.crc32(raw)


def test_shards(spark):
    check_shards(sharding.shards(spark, hard(spark)).collect(), Counter(shard_key(r[0], r[1]) for r in hard_rows()))


@needs_tables
def test_shard_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_shards(catalog.QUERIES["op6_hilbert"](spark, SF).collect(), Counter(shard_key(r.doc_id, r.text) for r in docs))


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = hard(spark)
    sharding.write_shards(spark, docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collected(back, *docs.columns) == collected(docs, *docs.columns)


# 8

def brute_measures(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(grams)
    covered = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    import random

    rng = random.Random(8)
    texts = [r[1] for r in hard_rows()] + ["".join(rng.choice(["a ", "b ", "\n", " x ", "c\t", "# ", "\x0b"]) for _ in range(120)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(spark, docs).collect():
        want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


FEEDS = ["f", "ff", "find a leaf", "f a f", "\f", "\fa b", "a b\f", "\f f \f", " \x0b\fa\f\x0b", "of of of of of of", "auf " * 9 + "auf"]


def test_form_feeds_are_space_and_the_letter_f_is_not(spark):
    docs = spark.createDataFrame([(i, t, "en", "s0") for i, t in enumerate(FEEDS)], "doc_id long, text string, lang string, source string")
    for r in quality.judge(spark, docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(FEEDS[r.doc_id])
    assert {r.doc_id: r.n_tokens for r in mixing.weigh(spark, docs).collect()} == {i: len(WORD.findall(t)) for i, t in enumerate(FEEDS)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables")
def test_labels_agree_with_the_posterior(spark):
    """Accuracy on labels that the estimates never saw."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = catalog.QUERIES["op8_weak_supervision"](spark, sf).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in got}
    assert n.get((0, False, True), 0) <= 0.05 * sum(v for k, v in n.items() if k[0] == 0)
    assert n.get((1, False, False), 0) <= 0.005 * sum(v for k, v in n.items() if k[0] == 1)


# 9

def brute_near(docs: list[tuple], percent: int = 85) -> dict:
    def shingles(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                group[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return Counter((doc, len(sets[i]), low.get(find(i))) for i, (doc, _) in enumerate(docs))


def mutated(n: int) -> list[tuple]:
    """A text with copies of one to ten changed words each, chains of changes, and texts that share a line."""
    import random

    rng = random.Random(11)
    base = words(150, 77).split()
    out, line = [], words(13, 99)
    for i in range(n):
        w = list(base)
        for _ in range(i % 11):
            w[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
    w = list(base)
    for i in range(25):
        w[(i * 6) % 150] = f"chain{i}"
        out.append((500 + i, " ".join(w)))
    out += [(2000 + i, f"{line} {words(8 + i % 30, 300 + i)}") for i in range(60)]  # no id of another text: ids name components
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_groups(spark, percent):
    docs = [(r[0], r[1]) for r in hard_rows()] + mutated(120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dedup.near_groups(spark, df, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(docs, percent)
    firsts = Counter((r.component_id, r.n_shingles == 0) for r in got if r.first)
    assert all(n == 1 for (c, none), n in firsts.items() if not none and c is not None)


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_sketch_cuts_keep_to_the_stated_loss(t):
    from math import comb

    for size in range(1, 65):
        tail = lambda m: sum(comb(size, i) * t**i * (1 - t) ** (size - i) for i in range(m))  # noqa: B023, E731
        m = near_dedup.least_shared(size, t)
        assert m == 1 or tail(m) <= near_dedup.LOSS
        assert tail(m + 1) > near_dedup.LOSS


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_sketches_share_what_is_sure(percent):
    import random

    rng = random.Random(5)
    for _ in range(3000):
        n = rng.choice([rng.randint(1, 40), rng.randint(41, 130), rng.randint(131, 2500)])
        extra = rng.randint(0, near_dedup.spare(n, percent))
        a = rng.sample(range(10**9), n)
        common = rng.randint(max(1, n - near_dedup.spare(n, percent)), n)
        if 100 * common < percent * (n + extra):
            continue
        x, y = sorted(a), sorted(a[:common] + [10**9 + i if rng.random() < 0.5 else -i - 1 for i in range(extra)])
        rx, ry = (z[: near_dedup.retained(len(z), percent)] for z in (x, y))
        shared = len({*rx} & {*ry})
        assert shared >= max(near_dedup.sure_common(len(z), percent) for z in (x, y))


def exchanged(base: list[str], places: list[int], tag: str) -> str:
    return " ".join(f"{tag}{i}" if i in places else w for i, w in enumerate(base))


@pytest.mark.parametrize("percent", [85, 80])
def test_links_at_the_threshold(spark, percent):
    """Texts whose overlap is the least that links, and one shingle less, at many sizes."""
    docs = []
    for size in [*range(6, 60, 3), 80, 107, 150, 240, 400, 901]:
        base, n = words(size, 7000 + size).split(), size - 4
        most = next(c for c in range(n, -1, -1) if 100 * c < percent * (2 * n - c))  # common shingles that don't link any more
        for common in (most, most + 1):
            gone = n - common  # cut from the end: as many words changed
            docs.append((size * 10, " ".join(base)))
            docs.append((size * 10 + 1 + common - most, exchanged(base, list(range(size - gone, size)), f"t{common}x")))
    docs = list(dict.fromkeys(docs))
    got = near_dedup.near_groups(spark, spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    want = brute_near(docs, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert any(i != c for i, _, c in want) and any(i == c and i % 10 for i, _, c in want)


@pytest.mark.parametrize("shared", [12, 40])
def test_a_passage_in_all_documents_makes_few_pairs(spark, monkeypatch, shared):
    seen, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, label, most=None: seen.setdefault(label, save(self, df, label, most)))
    counts, drop = {}, Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, *labels: (counts.update({n: seen[n].count() for n in labels if "pairs" in n}), drop(self, *labels)))
    passage = words(shared, 5)
    docs = [(i, f"{words(60, 9000 + i)} {passage} {words(30, 20_000 + i)}") for i in range(600)]
    got = near_dedup.near_groups(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.filter("component_id = doc_id").count() == 600
    assert counts["star-pairs"] + counts["cross-pairs"] <= 600


def test_a_large_group_of_near_copies_meets_few_others(spark, monkeypatch):
    """Most members of the group's lists are in one component; only the others are compared across."""
    import random

    rng, base = random.Random(3), words(200, 42).split()
    docs = [(1000 + i, exchanged(base, [rng.randrange(200)], f"u{i}x")) for i in range(300)]
    docs += [(5000 + i, exchanged(base, list(range(10 * i, 10 * i + 12)), f"v{i}x")) for i in range(12)]
    seen, drop = {}, Scratch.drop

    def noted(self, *labels):
        seen.update({n: self.spark.read.parquet(f"{self.root}/{n}").count() for n in labels if "pairs" in n})
        drop(self, *labels)

    monkeypatch.setattr(Scratch, "drop", noted)
    got = near_dedup.near_groups(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(docs)
    assert seen["star-pairs"] + seen["cross-pairs"] < 40 * len(docs)


def test_an_estimate_may_drop_links_at_the_stated_chance(spark):
    docs = mutated(60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    exact, cut = (sum(r.component_id != r.doc_id for r in near_dedup.near_groups(spark, df, loss=x).collect()) for x in (0.0, near_dedup.LOSS))
    assert exact - 2 <= cut <= exact


def test_near_stage_keeps_one(spark):
    docs = hard_rows() + [(doc, text, "en", "s0", len(text)) for doc, text in mutated(40)]
    kept = near_dedup.keep_one(spark, spark.createDataFrame(docs, SCHEMA)).collect()
    group = {doc: low for doc, _, low in brute_near([(r[0], r[1]) for r in docs])}
    assert group[1] == group[2] == group[13] == 1 and group[3] == 3  # 51 of 61 shingles: under 85 in 100
    with_words = Counter(group[r.doc_id] for r in kept if r.doc_id is not None and WORD.search(r.text or ""))
    assert with_words == dict.fromkeys({group[r[0]] for r in docs if r[0] is not None and WORD.search(r[1] or "")}, 1)
    ids = Counter(r.doc_id for r in kept)
    assert ids[4] == ids[5] == ids[6] == 1 and ids[None] == 2


# 10

def brute_runs(docs: list[tuple], least: int) -> Counter:
    seen, out = {}, Counter()
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    for i in order:
        run = []
        for start, end, n, digest in [*line_dedup.units(docs[i][1] or ""), (None, None, 0, None)]:
            if digest is not None and digest in seen:
                run.append((start, end, n, seen[digest]))
                continue
            if sum(x[2] for x in run) >= least:
                out[(docs[i][0], run[0][0], run[-1][1], sum(x[2] for x in run), *run[0][3])] += 1
            run = []
            if digest is not None:
                seen[digest] = (docs[i][0], start)
    return out


def test_repeated_runs(spark):
    passage = ". ".join(words(9, 40 + i) for i in range(6)) + "."
    docs = [(r[0], r[1]) for r in hard_rows()]
    docs += [(50, f"{words(20, 1)}. {passage} {words(9, 2)}"), (51, f"x.\n{passage.upper()}\nEnd"), (52, words(80, 9)), (53, passage[:40])]
    got = Counter(tuple(r) for r in line_dedup.repeated_runs(spark, spark.createDataFrame(docs, "doc_id long, text string")).drop("row_id").collect())
    assert got == brute_runs(docs, line_dedup.MIN_WORDS)
    assert any(k[0] == 51 and k[4] == 50 for k in got) and not any(k[0] in (50, 52, 53) for k in got)


def test_removed_spans_rebuild_the_text(spark):
    passage = ". ".join(words(9, 40 + i) for i in range(6)) + "."
    docs = [(1, passage), (2, f"é one. {passage} two"), (3, None)]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == passage and got[1].removed_spans is None and got[3].text is None
    text, (start, end) = docs[1][1], tuple(got[2].removed_spans[0])
    assert text[start:end] == passage and got[2].text == text[:start] + text[end:]


def test_short_repeats_are_removed(spark):
    line = words(7, 61)
    docs = [(1, f"{line}\n{words(9, 62)}"), (2, f"{words(9, 63)}\n{line}\n{words(9, 64)}"), (3, f"{words(9, 65)}. {line}")]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[0][1]
    for doc, text in docs[1:]:
        assert got[doc].text == text.replace(line, "") and len(got[doc].removed_spans) == 1


# the pipeline

def test_a_local_session_without_a_shared_folder_gets_one():
    class Context:
        applicationId = "app"

    class Session:
        sparkContext = Context

        def __init__(self, master):
            self.conf = {"spark.master": master}

    here = scratch_module.shared_dir(Session("local[2]"))
    assert os.path.isdir(here) and scratch_module.shared_dir(Session("local[2]")) == here
    with pytest.raises(RuntimeError):
        scratch_module.shared_dir(Session("spark://host"))


def test_tables_of_a_stage_go_when_the_next_begins(spark, tmp_path):
    hard(spark).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    first = as_stage(docs, lambda: exact_dedup.drop_copies(spark, docs))
    later = as_stage(first, lambda: near_dedup.keep_one(spark, first))  # reads the first stage's own tables: they stay
    assert first.count() == 11 and later.count() == 10
    folders = [s for s in scratch_module._through if s._fs.exists(s._path(s.root))]
    later.write.parquet(str(tmp_path / "later"))
    again = spark.read.parquet(str(tmp_path / "later"))
    assert as_stage(again, lambda: mixing.sample(spark, again)).count() <= 10
    assert folders and not any(s._fs.exists(s._path(s.root)) for s in folders)
    assert Scratch.made is None


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]


@needs_tables
def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.judge(spark, docs).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = {}
    for i in sorted(good):
        last[texts[i]] = i
    left = sorted(last.values())
    groups = brute_near([(i, texts[i]) for i in left])
    left = [i for (i, _, c), n in groups.items() if i == c]
    mixed = mixing.weigh(spark, docs.filter(F.col("doc_id").isin(left)))
    kept = [r.doc_id for r in mixed.filter("kept").collect()]
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, [(i, texts[i]) for i in kept], 2048)
    assert {r.doc_id for r in rows} <= good
