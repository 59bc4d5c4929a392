"""The training-data operators against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import gzip
import hashlib
import itertools
import pathlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliodex.llm import bpe, components, decontamination, html_wrappers, language_id, near_dedup, queries, repetition, sharding, substring_dedup, token_files, warc
from foliodex.llm.common import scratch

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, digest string, owner int, band string, sig string, bands int"


def words(seed, n, vocab=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names operators use themselves."""
    long_text = " ".join(words(1, 30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "é"), (4, "é"), (None, "no id here"), (5, long_text), (6, long_text), (7, "a b c " * 40), (8, " ".join(words(8, 60))), (9, " ".join(words(8, 60))), (10, "\x00 x　y ½")]
    return spark.createDataFrame([(i, t, "en", "x", 1, "b", "s", 0) for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# 1 ---------------------------------------------------------------------------------------------------------------


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_longest_repeats_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        s = np.unique(rng.integers(0, 3, rng.integers(1, 40)), return_inverse=True)[1]
        n = len(s)
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n)  # noqa: E731, B023
        want = [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        assert repetition.longest_from(s, 2).tolist() == [x if x >= 2 else 0 for x in want]


def test_quality_rules(spark, odd, none):
    got = repetition.repetition_rules(odd).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in odd.collect())
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert by[5].kept and by[8].kept and not by[7].kept
    assert repetition.repetition_rules(none).count() == 0
    passage, rest = words(2, 60, 10**6), words(3, 60, 10**6)
    twice = docs_of(spark, [(1, " ".join(passage + rest[:5] + passage))])
    r = repetition.repetition_rules(twice).first()
    assert r.longest_repeat == 60 and r.covered_words == 120 and not r.kept


def brute_verdict(text):
    """covered_words, longest_repeat and kept, by comparing every pair of places."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, covered, longest = len(w), set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j and w[i] == w[j]:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
        if best >= 8:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    failed = n < 50 or 100 * brute_base(text)[4] > 50 * n
    return len(covered), longest, not failed and len(covered) <= 0.5 * n and longest <= 0.35 * n


def test_verdicts_equal_brute_force(spark):
    rng, rows = random.Random(4), []
    for i in range(60):
        passage, rest = words(i, rng.randrange(5, 60), 10**6), words(500 + i, rng.randrange(20, 200), 30 + 10 * i)
        at = rng.randrange(len(rest))
        rows.append((i, " ".join(rest[:at] + passage + rest[at:] + passage * rng.randrange(0, 3))))
    got = repetition.repetition_rules(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.covered_words, r.longest_repeat, r.kept) for r in got} == {i: brute_verdict(t) for i, t in rows}
    assert 10 < sum(r.kept for r in got) < 55
    kept = repetition.keep_good(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [r for r in rows if brute_verdict(r[1])[2]]


def test_quality_rules_of_the_sample(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_quality_rules(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(texts[r.doc_id])


# 2 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_archives(spark, chunk):
    big = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 40
    rows = [(5, None, big), (3, "u\r\n", big), (9, "x", None), (None, "y", big), (8, "é", "é" * 60), (7, "", "é" * 60), (6, "z", "x\r\n\r\n"), (4, "q", "x\r\n\r\n"), (4, "q", "x\r\n\r\n"), (2, "r", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages, scratch(spark, "w"), chunk_bytes=chunk).collect()
    assert all(r.digest_ok for r in got)
    first = {}
    for i, _, h in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert warc.round_trip(pages.limit(0), scratch(spark, "w")).count() == 0


def test_long_payloads_in_many_archives(spark):
    long = [" ".join(words(k, 40_000)) for k in range(3)]
    rows = [(1, None, long[0], 9, "m"), (2, "u", long[1], 9, "m"), (3, "u", long[0], 9, "m"), (4, "u", long[2], 9, "m"), (4, "u", long[2], 9, "m")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk int, digest string")
    path = scratch(spark, "w")
    records = warc.record_rows(pages, chunk_bytes=1000)
    for r in records.where("record_id LIKE '2:%'").collect():
        assert r.running == hashlib.sha256(long[1].encode()[: 1000 * r.chunk]).hexdigest() and len(r.body) <= 1000
    got = {r.page_id: r for r in warc.round_trip(pages, path, chunk_bytes=1000, file_bytes=20_000).collect()}
    assert len(list(pathlib.Path(path.removeprefix("file://")).glob("*.gz"))) > 20
    assert all(got[i].digest_ok and got[i].payload_digest == hashlib.sha256(t.encode()).hexdigest() and got[i].payload_bytes == len(t) for i, t in ((1, long[0]), (2, long[1]), (3, long[0]), (4, long[2])))
    assert (got[3].record_type, got[3].refers_to, got[1].record_type) == ("revisit", 1, "response")


def test_damaged_archives(spark):
    text = "0123456789" * 40
    pages = spark.createDataFrame([(1, "u", text), (2, "u", text), (3, "u", "other " * 30)], "page_id long, url string, html string").coalesce(1)
    path = scratch(spark, "w")
    records = warc.record_rows(pages, chunk_bytes=100)
    changed = F.when((F.col("chunk") == 2) & F.col("record_id").startswith("1:"), F.lit("x" * 100).cast("binary")).otherwise(F.col("body"))
    warc.write_archives(records.withColumn("body", changed), path, records_per_file=100)
    read = {r.record_id[0]: r for r in warc.resolve_revisits(warc.read_records(warc.read_segments(spark, path))).collect()}
    assert not read["1"].running_ok and not read["2"].running_ok and read["2"].payload_digest == read["1"].payload_digest != read["1"].declared_digest
    assert read["3"].running_ok and read["3"].payload_digest == read["3"].declared_digest
    raw = next(pathlib.Path(path.removeprefix("file://")).glob("*.gz")).read_bytes()
    plain = gzip.decompress(raw)
    for cut in (raw[: len(raw) // 2], gzip.compress(plain[:-50]), gzip.compress(plain[:30])):
        feed = warc._Feed(cut)
        with pytest.raises(ValueError, match="ends inside"):
            while (line := feed.line()) is not None:
                if line:
                    feed.take(int(feed.header()["Content-Length"]))
    members = warc._Feed(gzip.compress(plain[:500]) + gzip.compress(plain[500:]), 64)
    assert members.take(len(plain)) == plain and members.line() is None
    dense = warc._Feed(gzip.compress(b"a" * 10**6), 512)
    while dense._more():
        assert len(dense.have) <= 512
        dense.pos = len(dense.have)


# 3 ---------------------------------------------------------------------------------------------------------------


def extracted(html):
    stream = html_wrappers.tokens(html)
    parser = html_wrappers.Parser(html_wrappers.shape(stream))
    assert parser.matches(stream)
    return parser.texts(stream)


def test_extraction_by_hand():
    assert extracted("<body><nav>m</nav><article><h1>T</h1><p>x<!-- c -->y<br>z<aside>no<p>q</aside><form>f</form><article class=comment>c</article><p>w &amp; v</article><p>out") == "T\nxy\nz\nw & v"
    assert extracted("<div class='post-content'><p>a<script>x<y</script><b>b</b></p><div class=\"comments\"><p>no</p></div><p>e\n f</div><footer>z") == "ab\ne f"
    assert extracted("") == "" and extracted("a < b") == "a < b"


UNCLOSED = [
    ("<article><p class=ad>x<p>real</p><p>real</p></article>", "real\nreal"),
    ("<article><ul><li class=share>x<li>one<li>two</ul><p>end</article>", "one\ntwo\nend"),
    ("<article><section><div class=ad>x<p>y</section><p>real</article><p>out", "real"),
    ("<div class=content><div><nav><ul><li>m</div><p>real</div>", "real"),
    ("<article><dl><dt>a<dd class=promo>x<dt>b<dd>c</dl><table><tr><td class=ad>x<td>1<tr class=menu><td>y<tr><td>2</table>z</article>", "a\nb\nc\n1\n2\nz"),
    ("<head><title>t</title><body><p>real", "real"),
    ("<article><p>a<span class=ad>x<p>real</article>", "a\nreal"),
    ("<article><div>a</span></p></section>b</div>c</article>", "a\nb\nc"),
    ("<body><div class='content with-sidebar'><p class='social-policy'>a</p><div id='notice-of-meeting'>b</div><div class='x ad'>no</div></div>", "a\nb"),
]


@pytest.mark.parametrize("html, text", UNCLOSED)
def test_excluded_elements_end_where_html_ends_them(html, text):
    assert extracted(html) == text


def test_wrappers_generalise():
    one, two = (html_wrappers.shape(html_wrappers.tokens(x)) for x in ("<ul><li>a</li></ul><p>x</p>", "<h2>t</h2><ul><li>a</li><li>b</li><li>c</li></ul><p>x</p>"))
    both = html_wrappers.Parser(html_wrappers.align(one, two))
    assert all(both.matches(html_wrappers.tokens(x)) for x in ("<ul><li>z</li></ul><p>y</p>", "<h2>q</h2><ul><li>a</li><li>b</li></ul><p>x</p>"))
    assert not both.matches(html_wrappers.tokens("<table></table>"))


def test_hosts_with_mixed_templates(spark):
    html = ["<article><p>one</p></article>", "<main><p>two</p></main>", "<div class=content><p>three</p></div><p>out", "<article class=post><p>four</p></article>", "<article><p>5</p></article><i>no</i><article class=post><p>6</p></article>", "<p>seven</p>", "<aside><article>no</article></aside><div class=content>8</div>"]
    want = ["one", "two", "three", "four", "5\n6", "seven", "8"]
    for url in ("http://mixed.example/", None):
        pages = spark.createDataFrame([(i, url, f"<html><body><nav>n</nav>{h}</body></html>") for i, h in enumerate(html)], "page_id long, url string, html string")
        got = html_wrappers.extract(pages).orderBy("page_id").collect()
        assert [r.text for r in got] == want and all(r.matched for r in got)


def test_constants_of_a_host_are_left_out(spark):
    one = lambda k: f"<body><div class=c1><a>Home</a><a>News</a></div><div class=c7>All rights kept</div><p>text {k}</p><p>more {k}</p><div class=c9>Imprint</div></body>"
    rows = [(k, "http://bare.example/", one(k)) for k in range(4)] + [(5, "http://alone.example/", one(5)), (6, "http://alone.example/", one(5)), (7, "http://named.example/", "<article><p>same</p><p>7</p></article>"), (8, "http://named.example/", "<article><p>same</p><p>8</p></article>")]
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(4)] == [f"text {k}\nmore {k}" for k in range(4)]
    assert got[5] == got[6] == "HomeNews\nAll rights kept\ntext 5\nmore 5\nImprint" and (got[7], got[8]) == ("same\n7", "same\n8")


def test_ambiguous_wrappers_are_matched_in_linear_time():
    wrapper = ["+", *[["?", "p", html_wrappers.SLOT, "/p"]] * 3]
    for _ in range(6):
        wrapper = ["+", wrapper, ["?", wrapper]]
    parser, page = html_wrappers.Parser([wrapper, "hr"]), html_wrappers.tokens("<p>x</p>" * 2000)
    assert not parser.matches(page) and parser.matches([*page, ("hr", None)])


def test_extraction_of_the_sample(spark):
    def plain(h):
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        return "\n".join(t for t in (" ".join(re.sub(r"<[^>]+>", "", p).replace("&amp;", "&").split()) for p in re.split(r"</?(?:p|h1|br)>", body)) if t)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op3_html_wrappers(spark, SF).collect()
    assert len(got) == len(pages) and all(r.matched and r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)
    odd = spark.createDataFrame([(1, None, None, "h"), (2, "http://a.b/", "<p>x", "h"), (2, "http://a.b/", "<p>x", "h")], "page_id long, url string, html string, host string")
    assert sorted((r.page_id, r.text) for r in html_wrappers.extract(odd).collect()) == [(1, ""), (2, "x"), (2, "x")]
    assert html_wrappers.extract(odd.limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------


def test_shards(spark, odd, none):
    got = sharding.byte_shards(odd, 3).collect()
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    for _, rows in itertools.groupby(sorted(got, key=lambda r: r.shard), key=lambda r: r.shard):
        assert sorted(r.slot for r in rows) == list(range(sum(1 for r in got if r.shard == _)))
    assert sharding.byte_shards(none, 3).count() == 0
    # the shard of each row of the sample by one prefix sum over all rows, and its place there
    sample = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in sample.collect())
    total, so_far, slots, want = sum(r[2] for r in rows), 0, collections.Counter(), {}
    for i, _, size in rows:
        shard = min(23, int((so_far + size / 2) * 24 / total))
        want[i] = (shard, slots[shard])
        slots[shard] += 1
        so_far += size
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.byte_shards(sample.repartition(7), 24).collect()} == want
    even = docs_of(spark, [(i, "x" * (i % 50)) for i in range(2000)])
    sizes = collections.Counter()
    last = -1
    for r in sharding.byte_shards(even, 24).orderBy("doc_id").collect():
        sizes[r.shard] += r.size
        assert r.shard >= last
        last = r.shard
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 57


# 5, 10 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


TEXTS = ["", "a  <|endoftext|> b<|endoftext|>", "  x\n\n y <|endo", "it's 12a ½ ²x　y​z\x00\n \n", "don't  'stop", "\r\n\tx  ", "日本語 🙂👩‍👧 ß", "x" * 300]


def test_ids_equal_the_library(library):
    table = bpe.word_table(queries.vocabulary())
    engine = bpe.encoding(queries.vocabulary())
    for t in TEXTS:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(table.encode([t])[0], "<i4").tolist() == want == engine.encode(t, allowed_special="all")
        assert table.decode(want) == library.decode(want, skip_special_tokens=False)


def test_a_full_table_begins_anew(library):
    small = bpe.WordTable(queries.vocabulary(), max_words=5)
    for t in ("one two three four five six seven", "eight nine ten", "one"):
        assert np.frombuffer(small.encode([t])[0], "<i4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_encoding(spark, odd, none, library):
    got = bpe.encode_decode(odd, queries.vocabulary(), with_ids=True).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(got) == odd.count() and bpe.encode_decode(none, queries.vocabulary()).count() == 0
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_token_files(spark, odd, none, library):
    path = scratch(spark, "tokens")
    token_files.write_token_files(odd, path, queries.vocabulary())
    got = token_files.checksums(token_files.read_token_files(spark, path)).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    at = 0
    for r, (_, text) in zip(got, rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    files = [pq.ParquetFile(f) for f in sorted(pathlib.Path(path.removeprefix("file://")).glob("*.parquet"))]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    for group in groups:
        columns = [group.column(k) for k in range(group.num_columns)]
        assert all(c.has_offset_index and c.has_column_index for c in columns)
        assert "RLE_DICTIONARY" in columns[3].encodings and all("DELTA_BINARY_PACKED" in c.encodings for c in columns[:3])
    where = token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens")
    assert "ids" not in where._jdf.queryExecution().executedPlan().toString()
    assert where.where("doc_id = 5").collect() == [r for r in where.collect() if r.doc_id == 5]
    path = scratch(spark, "tokens")
    token_files.write_token_files(none, path, queries.vocabulary())
    assert token_files.read_token_files(spark, path).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, n):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies(seed, n, groups):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = words(1000 + g, 120, 10**6)
        for k in range(n):
            copy = list(base)
            for _ in range(rng.randrange(0, 14)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((g * n + k, " ".join(copy)))
    return rows


def test_near_duplicates_equal_brute_force(spark, none):
    rows = near_copies(5, 60, 3) + [(500, "One Two"), (501, "one TWO"), (502, "lone"), (503, None), (504, ""), (505, "LONE")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(spark, rows), words=2).collect()}
    assert got == brute_components(rows, 2)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 5 and by[9].component_id == 8 and by[None].component_id is None and by[1].n_shingles == 0 and by[4].kept


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {1: 1, 2: 1}


def joined_rows(spark, since):
    """Rows that the joins of all executions after `since` made, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, made, last = store.executionsList(), 0, since
    for i in range(runs.size()):
        k = runs.apply(i).executionId()
        last = max(last, k)
        if k > since:
            values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
            for node in (nodes.apply(j) for j in range(nodes.size())):
                found = (node.metrics().apply(j) for j in range(node.metrics().size()))
                counts = [values.get(m.accumulatorId()) for m in found if "Join" in node.name() and m.name() == "number of output rows"]
                made += sum(int(n.get().replace(",", "")) for n in counts if n.isDefined())
    return made, last


def test_links_of_a_group_are_not_joined_in_every_round(spark):
    # one group: 500 members with 40 links each, and a path that takes many rounds
    dense = [(i, 1000 + (7 * i + k) % 500) for i in range(500) for k in range(40)]
    links = dense + [(1000 + i, 1001 + i) for i in range(500, 540)] + [(0, 1500)]
    edges = spark.createDataFrame(links, "a long, b long")
    last = joined_rows(spark, -1)[1]
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for link in links for i in link}
    assert 0 < joined_rows(spark, last)[0] < 3 * len(links)


def test_more_edges_join_known_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    of = lambda some: spark.createDataFrame(some, "a long, b long")
    whole = sorted(components.components(of(links)).collect())
    for k in (0, 60, 130):
        assert sorted(components.components(of(links[k:]), known=components.components(of(links[:k]))).collect()) == whole
    up = {}
    for a, b in links:
        if a != b:
            x, y = up.setdefault(a, {a}), up.setdefault(b, {b})
            x |= y
            up |= dict.fromkeys(x, x)
    assert {r.id: r.component for r in whole} == {i: min(group) for i, group in up.items()}


# 7 ---------------------------------------------------------------------------------------------------------------


def test_decontamination_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = {tuple(r) for r in con.execute(decontamination.ORACLE_SQL).fetchall()}
    assert {tuple(r) for r in queries.op7_decontamination(spark, SF).collect()} == want


def test_decontamination_of_odd_rows(spark, odd, none):
    w = words(77, 40, 10**6)
    items = spark.createDataFrame([(1, " ".join(w)), (2, "Just THREE words"), (3, None), (4, "..."), (None, "no id"), (2, "Just THREE words")], "item_id long, text string")
    docs = docs_of(spark, [(1, "x " + " ".join(w[20:]) + " y"), (2, "so: just-three_words! just"), (3, " ".join(w[:12])), (4, None), (5, "")]).unionByName(odd.select("doc_id", "text"))
    got = {r.doc_id: r for r in decontamination.contamination(docs, items).collect() if r.doc_id in (1, 2, 3, 4, 5)}
    assert (got[1].n_hit, got[1].n_items) == (20, 1) and (got[2].n_hit, got[2].items_sha256) == (3, hashlib.sha256(b"2").hexdigest())
    assert got[3].n_hit == 0 and not got[3].contaminated and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = docs_of(spark, [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "gamma beta alpha")])
    items = decontamination.item_terms(spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    postings = decontamination.build_index(docs)
    assert {r.doc_id for r in decontamination.proximity_matches(postings, items, span=10).collect()} == {1, 3}


def test_items_that_share_an_id(spark):
    a, b = ([f"{x}{k}" for k in range(20)] for x in "ab")
    benchmark = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b))], "item_id long, text string")
    got = decontamination.contamination(docs_of(spark, [(7, "x " + " ".join(b) + " y")]), benchmark).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(22, 20, 1, True)]


# 8 ---------------------------------------------------------------------------------------------------------------


def test_chunk_ends_equal_a_rolling_hash():
    raw = ("Ünd " + " ".join(words(3, 200)) + "é" * 50 + "y" * 9000).encode()
    ends, h, last = [], 0, 0
    for i, b in enumerate(raw):
        h = ((h << 2) + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        cut = (b in b" \t\n\r\x0b\x0c" and h < substring_dedup.AT_SPACE) or h < substring_dedup.ELSEWHERE
        if i + 1 == len(raw) or cut and raw[i + 1] & 0xC0 != 0x80:
            while i + 1 - last > substring_dedup.LONGEST:
                last += substring_dedup.LONGEST
                ends.append(last)
            ends.append(i + 1)
            last = i + 1
    assert substring_dedup.chunk_ends(raw).tolist() == sorted(set(ends))


def test_repeated_passages_go_once(spark, odd, none):
    passage = " ".join(words(9, 70, 10**6))
    rows = [(i, " ".join(words(100 + i, 80, 10**6)) + " " + passage + " " + " ".join(words(200 + i, 40, 10**6))) for i in range(5)] + [(9, " ".join(words(300, 200, 10**6)))]
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs_of(spark, rows)).collect()}
    cut = [i for i in range(5) if out[i].removed_bytes]
    assert len(cut) == 4 and all(0.5 * len(passage) < out[i].removed_bytes <= len(passage) + 2 for i in cut)
    assert out[9].removed_bytes == 0 and out[9].text == rows[-1][1]
    for i in cut:
        assert len(out[i].text) == len(rows[i][1]) - out[i].removed_bytes
    both = substring_dedup.dedup_substrings(odd)
    assert both.columns[: len(odd.columns)] == odd.columns
    got = both.collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and by[1].text is None and by[5].removed_bytes == 0 and by[6].text == "" and by[2].text == "" and by[None].text == "no id here"
    assert substring_dedup.dedup_substrings(none).count() == 0
    # columns of the measures' names: they give way to the measures, or stay beside a struct of them
    clash = spark.createDataFrame([(1, " ".join(words(1, 60)), 7)], "doc_id long, text string, n_bytes long")
    assert substring_dedup.dedup_substrings(clash).columns == ["doc_id", "text", "n_chunks", "n_repeated_chunks", "n_bytes", "removed_bytes"]
    (r,) = substring_dedup.dedup_substrings(clash, measures="m").collect()
    assert r.n_bytes == 7 and r.m.removed_bytes == 0 and r.m.n_bytes == len(" ".join(words(1, 60)))


def test_substrings_within_and_across(spark):
    """Of a passage in three texts one copy stays; a repeat inside one text goes however far apart; a short phrase stays."""
    text = lambda *a: " ".join(words(*a))
    passage, phrase = text(50, 60), text(51, 12)
    rows = [(k, f"{text(60 + k, 80)} {passage} {text(70 + k, 30)} {phrase} {text(80 + k, 20)}") for k in range(3)]
    rows.append((9, f"{text(90, 60)} {text(91, 40000, 10**6)} {text(90, 60)}"))
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs_of(spark, rows)).collect()}
    cut = [k for k in range(3) if out[k].removed_bytes]
    assert len(cut) == 2 and all(200 < out[k].removed_bytes <= len(passage) + 2 for k in cut)
    assert out[9].removed_bytes > 200 and all(phrase in out[k].text for k in range(3))


# 9 ---------------------------------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language_id.new_params(3, rng, 4).items()}
    x, label = rng.integers(0, 256, (5, 6)), rng.integers(0, 3, 5)
    _, g = language_id.gradients(p, x, label)
    for k in p:
        at = (int(x[0, 2]), 5) if k[0] == "x" else tuple(int(rng.integers(0, s)) for s in p[k].shape)
        losses = []
        for step in (1e-2, -1e-2):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            y = language_id.log_probs(q, x)
            losses.append(-np.mean([y[i, :, label[i]] for i in range(5)]))
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[k][at], rel=0.02, abs=2e-5)


def test_language_id_windows():
    """Windows side by side label as one run over the whole sequence does; letters are those of category L."""
    model = language_id.train({"a": ["one two three " * 40], "b": ["eins zwei drei " * 40]}, steps=30)
    texts = ["ein Wort und " + " ".join(words(k, n)) for k, n in ((1, 900), (2, 3), (3, 260), (4, 1))] + ["", "a"]
    got = language_id.Reader(model).read(texts)
    for text, y in zip(texts, got, strict=True):
        if text:
            whole = language_id.log_probs(model["params"], np.frombuffer(text.encode(), np.uint8)[None])[0].mean(axis=0)
            assert np.allclose(np.exp(y), np.exp(whole) / np.exp(whole).sum(), atol=0.02)
        else:
            assert not y.any()


def test_language_id(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, steps=150)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.identify(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    out = language_id.identify(odd.drop("lang"), model).collect()
    assert len(out) == odd.count() and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    signs = spark.createDataFrame([(1, "½ ² ① 12 _"), (2, "ª")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.identify(signs, model).orderBy("doc_id").collect()] == [True, False]
