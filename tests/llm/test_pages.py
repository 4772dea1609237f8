"""WARC archives with their index, and main-text extraction."""

import gzip
import hashlib
from collections import defaultdict

from plumbago.llm import warc
from plumbago.llm.html_text import extract_text, main_text

SCHEMA = "page_id long, url string, html string, digest string, file string, kept int"


def made():
    big, other = "<p>" + "payload é " * 150, "<p>other " * 200
    pages = [(1, None, None), (2, "", ""), (3, "http://www.b.example.com/x y?q=1#f", "tiny"), (4, "https://b.example.com:443/x%20y?q=1", "tiny"), (5, "no url at\nall", "é\r\n\r\nx")]
    pages += [(10 + i, f"http://h{i % 3}.example.org/p/{i % 5}", big) for i in range(20)]
    pages += [(40, "http://z.example.net:8080/", other), (39, "http://[bad", other), (50, "http://q/", "z" * 999), (51, "http://q/", "z" * 999)]
    return pages


def frame(spark, pages):
    return spark.createDataFrame([(*p, "d", "f", 1) for p in pages], SCHEMA).repartition(4)


def test_archives(spark):
    pages = made()
    by = defaultdict(list)
    for i, _, h in pages:
        by[(h or "").encode()].append(i)
    expected = set()
    for i, _, h in pages:
        raw = (h or "").encode()
        keep = max(by[raw])
        twice = len(raw) >= 1000 and keep != i
        expected.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if twice else "response", keep if twice else None))
    folder, captures = warc.write_archives(frame(spark, pages), file_bytes=3000)
    directory = warc.build_index(folder, captures, block_lines=3, shard_rows=12)
    got = warc.read_archives(folder, directory, with_payload=True).collect()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == expected and len(got) == len(pages)
    text = {i: h or "" for i, _, h in pages}
    assert all(r["payload"] == text[r["page_id"]] for r in got if r["record_type"] == "response")
    index = warc.CaptureIndex(folder, directory.collect())
    keys = {(warc.url_key(u) if u else warc.record_name(i), i) for i, u, _ in pages}
    for i, u, h in pages:
        if u:
            assert {x[1] for x in index.captures(u)} == {j for k, j in keys if k == warc.url_key(u)}
    assert index.captures("http://absent.example.com/") == []
    fields, _, payload = index.records("http://z.example.net:8080/")[0]
    assert fields["warc-type"] == "response" and payload.decode() == text[40]


def test_archive_files_are_plain_warc(spark):
    folder, captures = warc.write_archives(frame(spark, made()))
    name = captures.first()["file"]
    with warc.open_file(folder, name) as source:
        raw = gzip.decompress(source.read())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Record-ID") == captures.where(captures.file == name).count()


def test_no_pages(spark):
    folder, captures = warc.write_archives(frame(spark, made()).limit(0))
    assert warc.read_archives(folder, warc.build_index(folder, captures)).count() == 0
    assert extract_text(frame(spark, made()).limit(0)).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.a.Example.com:443/x?y#z") == "com,example,a)/x?y"
    assert warc.url_key("http://a.example.com:8080") == "com,example,a:8080)/"


def test_main_text():
    page = """<html><head><title>No</title><style>p{}</style></head><body class="home"><header>Top</header>
    <nav><ul><li><a href=/>Menu</a></ul></nav><div class="cookie-notice">We use cookies.</div><!-- x > y -->
    <div class="ad">Buy now</div><article class="post"><h1>A  title &amp; more</h1><p>First
    para<b>graph</b>.<p>Second<br>line &lt;x&gt;<aside>Side</aside><script>var a = "</p>";</script><p>Third <a href=x>link</a></p>
    <form><input><button>Go</button></form><ul><li>One<li>Two</ul><div id="comments"><p>Reader says</p></div></article>
    <section class="comments"><p>Another reader says more than enough words here</p></section><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "A title & more\nFirst paragraph.\nSecond line <x>\nThird link\nOne\nTwo"


def test_main_text_without_article():
    body = "<div>" + "".join(f"<p>Paragraph {i} has a good many words in it, as texts do.</p>" for i in range(6)) + "</div>"
    page = f"<div class=menu><a href=1>One</a></div>{body}<div class=footer-links>Imprint</div><div>Short</div>"
    assert main_text(page).startswith("Paragraph 0") and main_text(page).count("\n") == 5


def test_main_text_odd_pages():
    assert main_text(None) == main_text("") == main_text("<!-- open") == main_text("<script>x") == main_text("   ") == ""
    assert main_text("just text") == "just text"
    assert main_text("<article><p>cut of") == "cut of"
    assert main_text("<article><p>a</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "a\ndeep"


def test_main_text_keeps_short_regions():
    body = "".join(f"<p>Paragraph {i} has a good many words in it, as texts do.</p>" for i in range(60))
    page = f"<h1>Floods</h1><div class=ad>Buy</div><p>A lead of a few words only.</p><aside>x</aside>{body}<div class=ad>Buy</div><p>Short.</p><div class=ad>Buy</div><p>A closing section after an advert.</p><div class=share>s</div><div>End</div>"
    got = main_text(page).split("\n")
    assert got[:2] == ["Floods", "A lead of a few words only."] and got[-2:] == ["Short.", "A closing section after an advert."] and len(got) == 64
    assert main_text(f"<article><p>Small one.</p></article><article>{body}</article>").startswith("Small one.\nParagraph 0")


def test_main_text_inside_layout_wrappers():
    body = "".join(f"<p>Paragraph {i} has a good many words in it, as texts do.</p>" for i in range(6))
    noise = "<aside><p>Teasers</p></aside><div class=comments><p>A reader says something here.</p></div>"
    want = body.replace("<p>", "").replace("</p>", "\n").strip()
    for wrapper in ("div class='content no-sidebar'", "div class='has-sidebar'", "div class='elementor-widget'", "div class='l-side main'", "form id=aspnetForm"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
            assert main_text(f"<nav><a href=/>Menu</a></nav><{wrapper}>{inner}{noise}</{wrapper.split()[0]}><footer>f</footer>") == want, (wrapper, inner)
    parts = "".join(f"<div class='elementor-widget'>{p}</p></div>" for p in body.split("</p>")[:-1])
    assert main_text(parts + noise) == want
    teaser = "<aside><article><p>Read on about something else.</p></article></aside>"
    assert main_text(f"<form>{teaser}<article>{body}</article></form>") == main_text(f"{teaser}<article>{body}</article>") == want
    assert main_text(f"<div class=has-sidebar>{body}<div class=sidebar><p>Other matters.</p></div></div>") == want
    many = "<p>A reader says a lot more than the text does.</p>" * 30
    assert main_text(f"<div>{body}</div><div class=comments>{many}</div><div hidden>{many}</div>") == want


def test_main_text_with_letters_that_grow():
    assert main_text("<article><p>" + "\u0130" * 30 + "</p><SCRIPT>var a</Script><p>First one.</p><style>x</style><p>Second one.</p></article>") == "\u0130" * 30 + "\nFirst one.\nSecond one."
    assert main_text("<head><title>\u0130\u0130</title><BODY><p>Text after an open head.</p>") == "Text after an open head."


def test_extraction_keeps_rows(spark):
    rows = extract_text(frame(spark, [(1, "u", "<article><p>é x</p></article>"), (None, None, None), (1, "u", "<article><p>é x</p></article>")])).collect()
    assert sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in rows if r["page_id"]) == [(1, "u", "é x", 3)] * 2
    assert [tuple(r) for r in rows if r["page_id"] is None] == [(None, None, "", 0)]


def test_quotes_inside_unquoted_values():
    assert main_text("<article><p title=it's>Hello</p><p>It's fine</p></article>") == "Hello\nIt's fine"
    assert main_text("<article><p title='a > b' data-x=\"c > d\">Hello</p></article>") == "Hello"


def test_names_that_tell_a_subject():
    long = "A section about earlier work in the field, " * 4
    page = f"<article><p class='social-history'>Kept.</p><div id=related-work><p>{long}</p></div><div class='related-posts'><a href=x>One</a> <a href=y>Two</a></div><div class=comment-list><p>{long}</p></div></article>"
    assert main_text(page) == "Kept.\n" + long.strip()
