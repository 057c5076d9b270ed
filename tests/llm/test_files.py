import hashlib
import io
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import html_text, media_jpeg, warc

from .tables import empty, frames

PAGES = "page_id bigint, url string, html string, digest string, key string, known bigint"


@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=4))
@settings(max_examples=40, deadline=None)
def test_jpeg_round_trip_and_general_decoder(parts):
    payloads = [p + bytes(-len(p) % 64) for p in parts]
    files = media_jpeg.encode(payloads)
    for (data, pixels, error), payload, file in zip(media_jpeg.read_media(files, [len(p) for p in payloads]), payloads, files):
        assert data == payload and error is None
        assert (media_jpeg.decode(file) == pixels).all()
        # the bit reader and the reader of whole bands fill equal coefficient arrays
        picture = media_jpeg.Picture(file)
        assert (np.concatenate(media_jpeg.coefficients(picture)) == media_jpeg.plain_coefficients([picture])).all()


def test_inverse_transform_by_definition():
    rng = np.random.default_rng(2)
    sent = rng.integers(-255, 256, (3, 64))
    got = media_jpeg.samples(sent)
    scale = lambda u: np.sqrt(1 / 8) if u == 0 else 0.5
    for block in range(3):
        grid = np.zeros((8, 8))
        for k, place in enumerate(media_jpeg.ZIGZAG):
            grid[place // 8, place % 8] = sent[block, k]
        for y in (0, 3, 7):
            for x in (0, 5):
                v = sum(
                    grid[u, w] * scale(u) * scale(w) * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16) for u in range(8) for w in range(8)
                )
                assert abs(int(got[block, 8 * y + x]) - min(255, max(0, v + 128))) <= 1.5


def test_general_scans_with_runs_and_refinement():
    """A one-component file by hand: a first AC scan with zero runs and an end-of-band run, then a refinement with a new coefficient."""
    dc = media_jpeg._table(0x00, 0)
    ac = media_jpeg._segment(0xC4, bytes([0x10, 0, 3]) + bytes(14) + bytes([0x01, 0x11, 0x10]))  # codes 00, 01, 10
    frame = media_jpeg._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))

    def bits(text):
        return int(text.ljust(-(-len(text) // 8) * 8, "1"), 2).to_bytes(-(-len(text) // 8), "big")

    one = lambda a, b, h, low: media_jpeg._scan([1], a, b, h, low)
    # block 0: +1 at 1, then one zero and -1 at 3, then the end for two blocks (symbol 0x10, one bit 0)
    first = bits("00" + "1" + "01" + "0" + "10" + "0")
    # refinement, block 0: a new +1 at 2 (no zeros before it): coefficient 1 corrected on the way, then the end for two blocks with 3 corrected
    again = bits("00" + "1" + "0" + "10" + "0" + "1")
    data = media_jpeg._HEAD + frame + dc + one(0, 0, 0, 0) + bits("00") + ac + one(1, 5, 0, 1) + first + ac + one(1, 5, 1, 0) + again + b"\xff\xd9"
    found = media_jpeg.coefficients(media_jpeg.Picture(data))[0]
    assert found[0, :6].tolist() == [0, 2, 1, -3, 0, 0] and not found[1].any()


def other_file():
    """A progressive file that store() does not write: one component, other tables and scans."""
    dc, ac = media_jpeg._table(0x00, 0), media_jpeg._table(0x10, 0x00)
    frame = media_jpeg._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    return media_jpeg._HEAD + frame + dc + media_jpeg._scan([1], 0, 0, 0, 0) + b"\x3f" + ac + media_jpeg._scan([1], 1, 63, 0, 0) + b"\x3f" + b"\xff\xd9"


def test_media_column_of_any_files(spark, tmp_path):
    own = media_jpeg.encode([bytes(range(64))])[0]
    rows = [(1, 64, 64, own), (2, None, None, other_file()), (3, None, None, None), (4, None, None, b"\xff\xd8\xff\xc0\x00\x04xx"), (5, 64, 64, own[:40]), (6, None, None, own)]
    media_jpeg.decoded(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary")).write.parquet(f"{tmp_path}/tensors")
    found = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/tensors").collect()}
    for i in (1, 2, 6):
        r = found[i]
        assert np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], r["channels"]).tolist() == media_jpeg.decode(rows[i - 1][3]).tolist() and r["error"] is None
    assert bytes(found[1]["payload"]) == bytes(range(64)) and found[6]["payload"] is None and (found[2]["height"], found[2]["width"], found[2]["channels"]) == (8, 16, 1)
    assert all(found[i]["rgb"] is None and found[i]["error"] for i in (3, 4, 5))


def test_media_of_all_cases(spark):
    docs, _ = frames(spark, 40)
    rows = media_jpeg.digests(media_jpeg.decoded(media_jpeg.store(docs))).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    seen = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert seen.setdefault(data, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    nothing, _ = empty(spark)
    assert media_jpeg.digests(media_jpeg.decoded(media_jpeg.store(nothing))).count() == 0


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>", "d", "k", 1) for i in range(40)]
    rows += [(100 + i, "u", "<p>same</p>", "d", "k", 1) for i in range(30)]
    rows += [(200, None, None, None, None, None), (201, "u", "", "d", "k", 1), (202, "u\r\nx", "é" * 5000, "d", "k", 1), (None, "u", "<p>same</p>", "d", "k", 1)]
    return spark.createDataFrame(rows, PAGES).repartition(3), rows


@pytest.mark.parametrize("least", [0, 1000])
def test_archives(spark, least):
    table, rows = pages(spark)
    found = warc.read_archives(warc.write_archives(table, least)).collect()
    assert {r["kind"] for r in found} == {"record"} and len(found) == len(rows)
    best = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            best[html or ""] = max(best.get(html or "", page_id), page_id)
    for r in found:
        html = next(h for p, _, h, *_ in rows if p == r["page_id"]) or ""
        own = len(html.encode()) < least or r["page_id"] == best[html]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), warc.digest32(html.encode()))
        if r["page_id"] is not None:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", best[html]))
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


def test_frequent_payloads_take_the_other_way(spark):
    table, _ = pages(spark)
    few = {(r["page_id"], r["response"]) for r in warc.classified(table, frequent=1000).collect()}
    assert few == {(r["page_id"], r["response"]) for r in warc.classified(table, frequent=1).collect()}


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    rng = random.Random(4)
    records = [warc.record(i, f"http://x/{i}", rng.randbytes(200 * i)) for i in range(30)]
    parts = [warc.member(r) if packed else r for r in records]
    data = b"".join(parts)
    assert [k for k, *_ in warc.Salvage(io.BytesIO(data))] == ["record"] * 30
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    damaged = bytearray(data)
    for i in (7, 20):
        for j in range(starts[i] + 40, starts[i] + 90):
            damaged[j] ^= 0x55
    damaged = bytes(damaged[: starts[12]]) + b"some junk" + bytes(damaged[starts[12] : starts[29] + 30])
    found = list(warc.Salvage(io.BytesIO(damaged)))
    ids = [warc._page_id(x["head"]["warc-record-id"]) for k, _, _, x in found if k == "record"]
    assert ids == [i for i in range(29) if i not in (7, 20)]
    gaps = [(o, n) for k, o, n, _ in found if k == "gap"]
    assert gaps[0] == (starts[7], len(parts[7])) and gaps[1] == (starts[12], 9) and len(gaps) == 4
    covered = sorted((o, o + n) for _, o, n, _ in found)
    assert covered[0][0] == 0 and covered[-1][1] == len(damaged) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu one</a></li></ul></nav><header><p>Site head</p></header><div class="cookie-notice">We use cookies</div>
%s<aside><p>Side bar text that is long enough to be text</p></aside><div id="comments"><p>Reader says something long here, really</p></div>
<form><label>Mail</label><input></form><div class="ad">Buy now</div><footer>&copy; foot</footer></body></html>"""


def test_article_element():
    inner = "<article><h1>Head &amp; line</h1><p><b>One  two\n three<br><p>Four &#x41; <a href=x>linked</a></p><script>x</script><p>x</p></article>"
    assert html_text.extract(PAGE % inner) == "Head & line\n\nOne two three\n\nFour A linked\n\nx"


def test_surge_and_dive_without_article():
    inner = "<div><h1>Head line</h1><p>A first paragraph that has some length to it.</p><p>And one more paragraph of text here.</p></div>"
    assert html_text.extract(PAGE % inner) == "Head line\n\nA first paragraph that has some length to it.\n\nAnd one more paragraph of text here."


def test_distribution_decides_beside_an_article():
    body = "".join(f"<p>Paragraph {i} of the long text that the page is about, told at some length.</p>" for i in range(9))
    got = html_text.extract("<article><p>Teaser</p></article>" + "<div class=ad>x</div>" * 8 + f"<div>{body}</div>")
    assert got.startswith("Paragraph 0 of") and got.count("Paragraph") == 9 and "Teaser" not in got
    assert html_text.extract(f"<article><p>Start</p>{'<div class=ad>x</div>' * 9}<p>End</p></article>") == "Start\n\nEnd"


def test_short_sections_and_link_lines_stay():
    body = "<p>" + "A long paragraph of the article. " * 20 + "</p>"
    notices = "<div class=ad>x</div>" * 4
    page = f"<div><p>Opening.</p>{notices}{body}<p><a href=x>A paragraph that is a link</a></p>{body}{notices}<p>Closing words.</p>{notices}<p>End.</p></div>"
    got = html_text.extract(page).split("\n\n")
    assert [got[0], got[2], *got[4:]] == ["Opening.", "A paragraph that is a link", "Closing words.", "End."] and len(got) == 6
    links = "<p>Or <a href=x>some link to another page</a></p>" * 3
    assert "some link" not in html_text.extract(f"<div>{body}{notices}{links}</div>")


def test_attribute_syntax():
    page = "<article><p title=it's>Don't stop here</p><p>Next para isn't lost</p></article>"
    assert html_text.extract(page) == "Don't stop here\n\nNext para isn't lost"
    assert html_text.extract("<article><div data-id='search'><p>Body text</p></div></article>") == "Body text"
    assert html_text.extract("<article><p a='>' b=\"x>y\">Kept</p><p hidden>gone</p><p style='display: none'>gone</p><p data-x=hidden>stays</p></article>") == "Kept\n\nstays"
    assert html_text.extract("<div><p>Text <!--> shown</p><!-- a > b --><p>More</p></div>") == "Text shown\n\nMore"


def test_other_articles_are_not_the_main_text():
    body = "<p>A paragraph of the main article, long enough.</p>" * 3
    more = "<section><article><p>Another story that is only linked from here.</p></article></section>"
    assert "Another" not in html_text.extract(f"<article>{body}</article>{more}")
    assert "Another" not in html_text.extract(f"<article>{body}<article class=c1><p>Another voice</p></article></article>")


@pytest.mark.parametrize("piece", ["<b ", "<b a=\"", "<p><b>", "<div>", "</p>", "<li a='>", "<!--", "<a href=x>t", "<b a=\">\" ", "&amp", "<script>", "< ", "<p x=y>w"])
def test_a_hostile_megabyte(piece):
    began = time.process_time()
    html_text.extract("<p>Start</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 6


def brute_stretches(weights, window):
    """By definition: a line belongs to a stretch if some window over it up to WINDOW lines long starts above zero without a break."""
    alive = [any(weights[i : i + window]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(weights):
        if not alive[i]:
            i += 1
            continue
        j = i
        while j < len(weights) and alive[j]:
            j += 1
        inner = [k for k in range(i, j) if weights[k]]
        out.append((inner[0], inner[-1] + 1, sum(weights[k] for k in inner)))
        i = j
    return out


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_stretches_by_definition(weights, window):
    assert html_text.stretches(weights, window) == brute_stretches(weights, window)


def test_stretches():
    assert html_text.stretches([0, 5, 0, 7, 0, 0, 0, 2, 0], 3) == [(1, 4, 12), (7, 8, 2)]
    assert html_text.stretches([], 3) == [] and html_text.stretches([0, 0], 3) == []


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>", "<div class='ad'>x", "</p></div>", "<p>" * 500, "a < b & c"])
def test_odd_pages(page):
    assert isinstance(html_text.extract(page), str)


@given(st.text(alphabet=st.sampled_from(list("<>/pdiv ab\"'=&;!-\n")), max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_page(page):
    assert "\n\n\n" not in html_text.extract(page)


def test_pages_of_all_cases(spark):
    table, rows = pages(spark)
    found = html_text.main_text(table).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert by[3]["text"] == "page 3" and by[200]["text"] == "" and by[202]["n_chars"] == 5000 and by[200]["url"] is None
    assert html_text.main_text(table.limit(0)).count() == 0
