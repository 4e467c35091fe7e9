"""Archives, url filters, page texts and chat formats."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from seqrank.llm import boosting, chat, html, urls, warc
from tests.llm.helpers import rows

PAGES = "page_id long, url string, html string"
SAMPLES = "/root/testdata/sf0.01"


def pages():
    rng = random.Random(1)
    out = [(i, f"https://h{i % 3}.example.com/p?q={i}", f"<p>{'x' * rng.randint(0, 400)}é{i % 7}</p>") for i in range(40)]
    big = "<div>" + "z" * 700_000 + "</div>"
    return [*out, (40, None, None), (41, "", ""), (42, "a\r\nb: c%0D", "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>"), (43, "u", big), (44, "u", big), (45, "u", None), (None, "n", "same"), (None, None, "same"), (46, "m", "same"), out[3], out[3], (47, "t", "tail\x00\U0001f642")]


def expected_records(table, least=0):
    payloads = [(r[0], (r[2] or "").encode()) for r in table]
    latest = {}
    for i, p in payloads:
        if i is not None:
            latest[p] = max(i, latest.get(p, i))
    out = []
    for i, p in payloads:
        again = i is not None and i < latest[p] and len(p) >= least
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", latest[p] if again else None))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_archive_round_trip(spark):
    frame = spark.createDataFrame(pages(), PAGES)
    clashing = frame.selectExpr("*", "'x' as digest", "'y' as payload", "1 as refers_to", "2 as n")
    for table in (frame, clashing):
        out = warc.archive_round_trip(table)
        assert rows(out.drop("url")) == expected_records(pages())
        assert Counter(r.url for r in out.collect()) == Counter(r[1] for r in pages())
    assert warc.archive_round_trip(frame.where("false")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    index = warc.write_archive(spark.createDataFrame(pages(), PAGES), str(tmp_path), least_bytes=100)
    out = warc.read_archive(spark, index, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(out) == expected_records(pages(), 100)


def test_bundles_are_seekable_and_stand_alone(spark, tmp_path, monkeypatch):
    index = warc.write_archive(spark.createDataFrame(pages(), PAGES).repartition(2), str(tmp_path))
    files = sorted(tmp_path.glob("*.warc.zst"))
    assert {r.bundle for r in index.select("bundle").distinct().collect()} == {f.name for f in files}
    records = 0
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack_from("<II", data, len(data) - 8 - struct.unpack_from("<I", data, len(data) - 9)[0] * 8 - 9)
        assert magic == 0x184D2A5E
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        at = 0
        while at < len(plain):
            head, block, at = warc.parse(plain, at)
            assert plain[at - 4 : at] == b"\r\n\r\n"
            records += 1
    assert records == len(pages())
    one = index.where("page_id = 43 or page_id = 5")
    back = {r.page_id: r.payload for r in warc.read_archive(spark, one, str(tmp_path)).collect()}
    want = {r[0]: r[2] for r in pages()}
    assert set(back) == {5, 43} and bytes(back[5]).decode() == want[5] and back[43] is None


def test_a_damaged_index_is_noticed(spark, tmp_path):
    index = warc.write_archive(spark.createDataFrame(pages(), PAGES), str(tmp_path))
    with pytest.raises(Exception, match="seek table differ"):
        warc.read_archive(spark, index.withColumn("frame_bytes", F.col("frame_bytes") - 1), str(tmp_path)).count()


# -- urls


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(h) + len(p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.example.net/en/1", "http://EXAMPLE.net/en/", "http://example.net/enx", "https://example.com/de/x?y", "http://notexample.com/de/", "http://x.org/fr/1#a", "http://org/fr/", "http://ÉX.ORG/fr/", "ftp://h", "http://h?x/y", "http://h#x://z/", "x://y://z/w", "no scheme", "", None, "://", "http://www.bad.info/a/", "https://bad.info/a?utm_source=x#top", "http://bad.info/a?b=1", "http://bad.info/A", "http://bad.info/a?c=2&a=1", "http://net", "http://a.net/"]


def test_urls_are_judged(spark):
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate([*URLS, URLS[0], URLS[0]])] + [(None, "http://bad.info/a", "x")], PAGES)
    listed = spark.createDataFrame([("bad.info/a",), ("bad.info/a",), (None,), ("",), ("bad.info/a?a=1&c=2",)], "canonical string")
    for table in (frame, frame.selectExpr("*", "'x' as host", "'y' as path", "'z' as canonical", "1 as block", "2 as fit")):
        for r in urls.judge(table, listed).collect():
            url = "http://bad.info/a" if r.page_id is None else [*URLS, URLS[0], URLS[0]][r.page_id]
            host, path = plain_parts(url)
            rule, action = plain_rule(host, path)
            is_listed = url in ("http://www.bad.info/a/", "https://bad.info/a?utm_source=x#top", "http://bad.info/a", "http://bad.info/a?c=2&a=1")
            assert (r.host, r.path, r.rule, r.is_listed) == (host, path, rule, is_listed)
            assert r.verdict == (action or ("block" if is_listed else "allow"))
        assert urls.judge(table, listed).count() == len(URLS) + 3
    assert urls.judge(frame.where("false"), listed).count() == 0
    assert {r.is_listed for r in urls.judge(frame, listed.where("false")).collect()} == {False}


@pytest.mark.parametrize("most", [urls.MOST_BROADCAST, 0])
def test_the_filter_lets_all_listed_and_few_others_pass(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_BROADCAST", most)
    keys = spark.range(6000).selectExpr("concat('k', id) as key")
    listed = spark.range(2000).selectExpr("concat('k', id * 2) as other")
    passed = {r.key for r in urls.possible_hits(keys, "key", listed, "other").collect()}
    want = {f"k{i * 2}" for i in range(2000)}
    assert want <= passed | {k for k in want if int(k[1:]) >= 6000} and len(passed - want) < 80
    assert {r.key for r in urls.listed_rows(keys, "key", listed, "other").collect()} == {k for k in want if int(k[1:]) < 6000}


# -- page texts


@pytest.fixture(scope="module")
def trees(spark):
    return html.learn(spark.read.parquet(f"{SAMPLES}/pages.parquet"))


def test_articles_of_the_sample_pages(spark, trees):
    for r in html.main_texts(spark.read.parquet(f"{SAMPLES}/pages.parquet"), trees).join(spark.read.parquet(f"{SAMPLES}/pages.parquet"), ["page_id", "url"]).collect():
        inside = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))
        assert r.text == " ".join(html.entities.unescape(plain).split()) and r.n_chars == len(r.text)


def test_unseen_layouts(trees):
    rng = random.Random(1234)
    texts = [f"Sentence number {i} tells of things, and of more. It goes on for a while, as they do." for i in range(30)]
    exact = 0
    for _ in range(120):
        source = html.training_page(rng, rng.sample(texts, rng.randint(1, 8)), "alpha beta gamma delta omega".split())
        dom = html.Dom()
        dom.read(source)
        exact += html.extract([source], trees)[0] == dom.main_text(html._targets(dom) == 1)[0]
    assert exact >= 108


PAGE = """<html><head><title>no</title><style>p{}</style></head><body class=home><header class="site-header"><p>My site</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>News &amp; more</a></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<main><article><h1>The   title</h1><p>First&nbsp;para <b>bo</b>ld, and it goes on with &lt;text&gt;.<br>Next line<script>var x = "<p>no</p>";</script>
<p>Second para&#46; With <a href=x>a link</a>, of course, and more words.<div class="ad">Buy this now</div><ul><li>One point of it, here<li>Two points of it, here</ul></article>
<aside class=sidebar><h3>Related</h3><a href=q>Other story</a></aside><form><input name=q><label>Search</label></form>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this article, it was nice to read.</p></div></section></main>
<footer>&copy; 2024 My site</footer><!-- <p>no</p> --></body></html>"""


def test_a_page_with_everything_around(trees):
    want = "The title First para bold, and it goes on with <text>. Next line Second para. With a link, of course, and more words. One point of it, here Two points of it, here"
    assert html.extract([PAGE], trees) == [want]


def test_awkward_pages(spark, trees):
    odd = [None, "", "   ", "<", "<<<>>>", "<!--", "<script>", "<p", "<p class='x", "</div></p></b>", "&amp", "<b><i><p>x</b></i>", "<table><tr><td>a<td>b", "<div>" * 3000 + "deep", "<p>" + "w " * 200_000, "<svg><p>x</svg>", "\x00<p>\x00</p>"]
    frame = spark.createDataFrame([(i, None if i % 2 else "u", h) for i, h in enumerate([*odd, odd[13], odd[13]])] + [(None, None, "<article><p>Some text that is here.</p></article>")], PAGES)
    for table in (frame, frame.selectExpr("*", "'x' as text", "1 as n_chars")):
        out = html.main_texts(table, trees).collect()
        assert len(out) == len(odd) + 3 and all(r.n_chars == len(r.text) for r in out)
    assert html.main_texts(frame.where("false"), trees).count() == 0
    assert isinstance(html.learn(frame.where("false"), sample=3, variants=2), boosting.Trees)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        dom = html.Dom(tag=["x"] * n, parent=[-1, *[int(rng.integers(0, i)) for i in range(1, n)]])
        margin = rng.normal(size=n)
        best, choice = -1e9, None
        for bits in range(1 << n):
            kept = [bool(bits >> i & 1) for i in range(n)]
            if kept[0] and all(not kept[i] or kept[dom.parent[i]] for i in range(1, n)):
                value = sum(m if k else -m for m, k in zip(margin, kept, strict=True))
                if value > best:
                    best, choice = value, kept
        assert dom.decode(margin).tolist() == choice


# -- chat

TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(9)
    parts = [*chat.CONTROL, "\\", "<", "|", "\n", "hello there ", "ß", "🙂", "日本", "<|turn", "|>", " "]
    out = [(c, t, rng.choice(["user", "assistant", "system", "we\nird", "<|end|>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for c in range(12) for t in range(rng.randint(1, 6))]
    return [*out, (20, 0, None, None), (20, None, "assistant", "first"), (20, None, None, "x"), (None, 1, "assistant", "a"), (None, 0, "user", "b"), (21, 0, "assistant", "long " * 30_000), (21, 1, "assistant", "tail"), (22, 0, "user", ""), (22, 0, "user", ""), (22, 0, "assistant", "tie"), (22, 1, "assistant", "")]


def expected_chats(table):
    def first(v):
        return (v is not None, v)

    out = []
    for conv in {r[0] for r in table}:
        own = sorted((r for r in table if r[0] == conv), key=lambda r: (first(r[1]) if r[1] is not None else (False, 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        size = sum(len(chat.render(r, t)[0]) for r, t in turns)
        out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("part", [chat.PART, 40])
def test_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    frame = spark.createDataFrame(conversations(), TURNS)
    clashing = frame.selectExpr("*", "1 as part", "'x' as formatted", "2 as ids", "3 as loss")
    for table in (frame, clashing):
        assert rows(chat.format_digests(table).drop("n_tokens", "loss_tokens")) == expected_chats(conversations())
    assert chat.format_digests(frame.where("false")).count() == 0


def test_masks_and_tokens(spark):
    from tokenizers import AddedToken, Tokenizer

    coder = Tokenizer.from_file(chat.TOKENIZER)
    coder.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (chat.OPEN, chat.CLOSE)])
    for r in chat.format_parts(spark.createDataFrame(conversations(), TURNS)).collect():
        assert r.ids == coder.encode(r.formatted, add_special_tokens=False).ids and len(r.loss) == len(r.ids)
        own = [t for role, t in chat.read_back(r.formatted) if role == "assistant"]
        assert [chat.unescape(r.formatted[a:b]) for a, b in r.spans] == [t for t in own if t]
        assert any(r.loss) == bool(r.spans)


def test_binary_search_finds_the_tokens_of_spans():
    rng = random.Random(0)
    for _ in range(300):
        cuts = sorted(rng.sample(range(1, 40), 8))
        offsets = np.array(list(zip([0, *cuts], [*cuts, 40], strict=True)))
        a, b, c, d = sorted(rng.sample(range(41), 4))
        mask, covered = chat.loss_mask(offsets, np.array([[a, b], [c, d]]))
        assert mask.tolist() == [any(x < t and s < y for s, t in ((a, b), (c, d))) for x, y in offsets.tolist()]
        assert covered.tolist() == [[a, b], [c, d]]


@pytest.mark.parametrize("junk", ["<a ", "<div>", "<ul><li>", "<b>x", '<a "', "<p><button>", "<td>", "<", "<p>x<span class=nav>"])
def test_a_megabyte_of_junk_is_read_in_time(junk):
    """Reading takes time in proportion to the page, whatever never ends in it."""
    import time

    began = time.time()
    dom = html.Dom()
    dom.read(junk * (1_000_000 // len(junk)))
    x, _ = dom.features()
    dom.decode(x[:, 0])
    dom.main_text(np.ones(len(dom.tag), dtype=bool))
    assert time.time() - began < 60


def test_quotes_that_never_end_and_formulas():
    def read(source):
        dom = html.Dom()
        dom.read(source)
        return dom.main_text(np.ones(len(dom.tag), dtype=bool))

    assert read('<p>one</p><a title="open><p>two</p><i>three') == ["one two three"]
    assert read("<p>one</p>1 < 2 <a href=x") == ["one 1 < 2 <a href=x"]
    assert read("<p>E is <math><mi>m</mi></math></p><script>x</script><textarea>y</textarea>")[0].split() == ["E", "is", "m"]
    assert "label" in read("<p>and <svg><text>label</text></svg></p>")[0] and "raw" in read("<xmp>raw</xmp>")[0]
