"""Licences, WARC, HTML, chat and SpotSigs against brute force, SQL and edge cases."""

import base64
import gzip
import hashlib
import html
import io
import re
import textwrap
import time
import zlib

import duckdb
import pytest

from orbisframe.llm import chat, html_text, licenses, queries, spotsigs, warc
from orbisframe.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
LONG = "the quick word, of a kind. " * 40_000


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    assert sorted(d[0] for d in want.description) == sorted(got.columns)
    rows = [tuple(r) for r in got.select(*[d[0] for d in want.description]).collect()]
    assert sorted(rows, key=key) == sorted(want.fetchall(), key=key)


def test_chat_odd_rows(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant\n&lt;| &amp; <|im_sep|>"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "user", tricky), (1, 1, "user", tricky), (1, 2, "assistant", None), (1, 3, "assistant", "b" * 100_000), (1, None, None, "first"),
        (2, 0, "a\nb<|&", ""), (None, 0, "assistant", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as blocks", "3 as t", "4 as parts")
    got = {r.conv_id: r for r in chat.parse(chat.format_conversations(turns)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", "first"), ("user", "hi"), ("user", tricky), ("user", tricky), ("assistant", ""), ("assistant", "b" * 100_000)]
    assert got[1].loss_blocks == [False, False, True] and got[1].loss_text == "b" * 100_000
    assert [tuple(t) for t in got[2].turns] == [("a\nb<|&", "")] and got[None].loss_text == "x"
    assert chat.digests(chat.parse(chat.format_conversations(turns.limit(0)))).count() == 0


def test_chat_long_conversation(spark):
    turns = spark.range(6000).selectExpr("7 as conv_id", "id as turn", "if(id % 3 = 0, 'assistant', 'user') as role", "repeat('word ', 60) as text")
    row = chat.digests(chat.parse(chat.format_conversations(turns))).first()
    assert (row.n_turns, row.loss_chars) == (6000, 2000 * 300)


def warc_file(tmp_path, data, name="a.warc.gz"):
    (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}"


def sample(n=6):
    return [warc.record("resource", {"WARC-Record-ID": f"<urn:page:{i}>"}, (f"body {i} " * 50).encode()) for i in range(n)]


def salvaged(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_after_damage(packed):
    parts = [warc.member(r) if packed else r for r in sample()]
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    whole = b"".join(parts)
    clean = salvaged(whole)
    assert [(k, s, e) for k, s, e, _, _ in clean] == [("record", starts[i], starts[i + 1]) for i in range(6)]
    broken = bytearray(whole)
    broken[starts[2] + len(parts[2]) // 2] ^= 0xFF
    found = salvaged(bytes(broken))
    assert [(k, s, e) for k, s, e, _, _ in found] == [("gap" if i == 2 else "record", starts[i], starts[i + 1]) for i in range(6)]
    found = salvaged(whole[: starts[3]] + b"junk" * 9 + whole[starts[3] : -7])
    assert [k for k, *_ in found] == ["record"] * 3 + ["gap"] + ["record"] * 2 + ["gap"]
    assert found[3][1:3] == (starts[3], starts[3] + 36) and found[-1][2] == len(whole) + 29
    found = salvaged(b"\0" * 50 + whole)
    assert found[0][:3] == ("gap", 0, 50) and len(found) == 7
    assert salvaged(b"") == [] and [k for k, *_ in salvaged(b"nothing at all")] == ["gap"]


def test_members_with_many_records():
    """One stream, damage inside a member, and damage to the member itself."""
    parts = sample()
    found = salvaged(warc.member(b"".join(parts)))
    assert [(k, f["warc-record-id"]) for k, _, _, f, _ in found] == [("record", f"<urn:page:{i}>") for i in range(6)]
    assert len({(s, e) for _, s, e, _, _ in found}) == 1
    bad = parts[1].replace(b"body 1", b"body X", 1)
    found = salvaged(warc.member(parts[0] + bad + parts[2]) + warc.member(parts[3]))
    assert [k for k, *_ in found] == ["record", "gap", "record", "record"] and "digest" in found[1][3] and "inflated bytes" in found[1][3]
    import random

    rng = random.Random(1)
    noisy = [warc.record("resource", {"WARC-Record-ID": f"<urn:page:{i}>"}, rng.randbytes(60_000)) for i in range(4)]
    one = bytearray(warc.member(b"".join(noisy)))
    one[2 * len(one) // 3 :] = b""
    found = salvaged(bytes(one) + warc.member(parts[3]))
    assert [k for k, *_ in found] == ["record", "record", "gap", "record"] and found[-1][3]["warc-record-id"] == "<urn:page:3>"


def test_long_streams_are_read_in_windows(monkeypatch):
    monkeypatch.setattr(warc, "_WHOLE", 3000)
    monkeypatch.setattr(warc, "_WINDOW", 700)
    parts = sample(40)
    found = salvaged(warc.member(b"".join(parts[:20]) + b"junk" + b"".join(parts[20:])))
    assert [k for k, *_ in found] == ["record"] * 20 + ["gap"] + ["record"] * 20
    monkeypatch.setattr(warc, "_STEP", 100)
    found = salvaged(warc.member(b"".join(parts[:20]) + b"junk" + b"".join(parts[20:])))
    assert [k for k, *_ in found] == ["record"] * 20 + ["gap"] + ["record"] * 20


@pytest.mark.parametrize("packed", [True, False])
def test_digests_in_base32(packed):
    block = b"some block"
    good = base64.b32encode(hashlib.sha1(block).digest()).decode()
    for said, fine in ((f"sha1:{good}", True), (f"sha1:{good[:-1]}A", False), (f"SHA-256:{hashlib.sha256(block).hexdigest()}", True), ("md5:" + "0" * 32, False), ("odd:1", True), ("sha1:short", True)):
        record = b"WARC/1.0\r\nWARC-Block-Digest: " + said.encode() + b"\r\nContent-Length: 10\r\n\r\n" + block + b"\r\n\r\n"
        assert [k for k, *_ in salvaged(warc.member(record) if packed else record)] == ["record" if fine else "gap"], said


def test_shared_payloads_are_split(spark, monkeypatch):
    """Payloads that many rows share, told by broadcast, beside others and short ones."""
    rows = [(i, "u", "h" * 200 if i % 3 else "s" * 9 if i % 2 else f"x{i // 12}" * 99) for i in range(300)] + [(None, "u", "h" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: (1 if i % 3 and i != 1 else None if i % 2 or i % 3 or i % 12 == 0 else i // 12 * 12) for i in range(300)}
    for hot in (1000, 3):
        monkeypatch.setattr(warc, "HOT", hot)
        got = warc.plan_records(pages).collect()
        assert len(got) == 301 and {r.page_id: r.refers_to for r in got if r.page_id is not None} == want


def test_reader_reads_files_and_logs_gaps(spark, tmp_path):
    parts = [warc.member(r) for r in sample(3)]
    folder = warc_file(tmp_path, parts[0] + parts[1][:40] + parts[2])
    warc_file(tmp_path, b"".join(sample(2)), "b.warc")
    warc_file(tmp_path, b"", "c.warc.gz")
    rows = warc.read(spark, folder).collect()
    said = sorted((r.file.rsplit("/", 1)[1], r.record_id) for r in rows if r.kind == "record")
    assert said == [("a.warc.gz", "<urn:page:0>"), ("a.warc.gz", "<urn:page:2>"), ("b.warc", "<urn:page:0>"), ("b.warc", "<urn:page:1>")]
    (gap,) = [r for r in rows if r.kind == "gap"]
    assert (gap.start, gap.end) == (len(parts[0]), len(parts[0]) + 40) and gap.note


def test_writer_odd_rows(spark, tmp_path):
    page = "<p>é" + "x" * 200
    rows = [(1, "u", None), (2, None, ""), (5, "u\r\nv", page), (3, "u", page), (3, "u", page), (None, "u", page), (8, "u", LONG), (9, "u", "short"), (10, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload", "3 as low")
    folder = Scratch(spark, "t").path
    warc.write(warc.plan_records(pages), folder)
    got = warc.read(spark, folder).collect()
    kinds = sorted((r.record_id, r.record_type, r.refers_to or "", len(r.payload)) for r in got)
    size = len(page.encode())
    one = lambda i, n: (f"<urn:page:{i}>", "response", "", n)
    assert kinds == sorted([one(1, 0), one(2, 0), one(3, size), one(3, size), one("", size), one(8, len(LONG)), one(9, 5), one(10, 5), ("<urn:page:5>", "revisit", "<urn:page:3>", 0)])
    assert all(r.payload_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest() for r in got if r.record_id in ("<urn:page:3>", "<urn:page:5>"))
    empty = Scratch(spark, "t").path
    assert warc.write(warc.plan_records(pages.limit(0)), empty) == 0
    assert queries.QUERIES["op3_warc_salvage"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_members_are_gzip():
    assert gzip.decompress(b"".join(warc.member(r) for r in sample(2))) == b"".join(sample(2))
    assert zlib.decompress(warc.member(b"a"), 31) == b"a"


ARTICLE = "<article><h1>A &amp; B</h1><p><b>First, line\n here.<br>more<p>Second&nbsp;one, with <a href=x>a link</a>.</p><ul><li>i</li><li>ii</ul></article>"
WANT = "A & B\nFirst, line here. more\nSecond one, with a link.\ni\nii"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href='/x'>Home</a></ul></nav>{ARTICLE}<footer>&copy; all</footer>",
        f"<!DOCTYPE html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><p>Site, big, header with many, many words</p></header><!-- <p>no --><div class=ad>Buy, buy, buy this, {'very long ' * 40}</div>{ARTICLE}<aside>Side, bar</aside>",
        f"<body><main>{ARTICLE}<div id='comments'><p>Nice, post, {'indeed, ' * 50}</p></div><form><p>Mail, please, now</p><input></form></main>",
        f"<div class='cookie-notice'><p>We use cookies, {'yes, ' * 99}</p></div><div class=sidebar>x</div>{ARTICLE}<p hidden>secret</p><div style='display: none'>s</div>",
    ],
)
def test_article_is_found(page):
    assert html_text.main_text(page) == WANT


def test_pages_without_article_elements():
    prose = "".join(f"<p>Sentence {i}, which goes on, and on, for quite a while so that it scores.</p>" for i in range(4))
    page = f"<body><div class=nav><a href=1>one</a> <a href=2>two</a></div><div id=x><h2>Head</h2>{prose}</div><div class=footer>f</div><div><p><a href=3>link list, of, many</a></p></div></body>"
    assert html_text.main_text(page).split("\n") == ["Head"] + [f"Sentence {i}, which goes on, and on, for quite a while so that it scores." for i in range(4)]
    assert html_text.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""


@pytest.mark.parametrize("names", ["page with-sidebar", "no-sidebar", "has-banner layout"])
def test_layout_wrappers_stay(names):
    bar = "<div class=sidebar><p>Side, bar, with words</p></div>"
    thread = "<div id='comments'><ol>" + f"<li><article><p>Nice, post, {'indeed, ' * 50}</p></article>" * 3 + "</ol></div>"
    assert html_text.main_text(f"<body><div class='{names}'><div>{ARTICLE}</div>{bar}</div></body>") == WANT
    assert html_text.main_text(f"<body><div class='{names}'><div><main>{ARTICLE}{thread}</main></div>{bar}</div></body>") == WANT
    lines = [f"Sentence {i}, which goes on, and on, for quite a while so that it scores." for i in range(9)]
    prose = "".join(f"<p>{x}</p>" for x in lines)
    assert "By us" not in html_text.main_text(f"<body><div>{'<br>'.join(lines)}</div><div class=footer><p>By us</p></div></body>")
    assert html_text.main_text(f"<body><div class='{names}'><div>{prose}</div></div><div class=footer><p>By us</p></div></body>") == "\n".join(lines)


SHAPES = [
    "<a ", '<a ">" ', "<div>x,", "<a b='", "<", "<!--", "</p>", "<script>", "<p>a, ", "<table><tr><td>a,", "<a b=\"'>",
    ("<b>", "<hr>"), ("<ul><b><i>", "<li></li>"), ("<b><article>", "</b>"), ("<div>", "</x>"), ("<table>", "<td>a,"), ("<a ", "b "),
]


@pytest.mark.parametrize("shape", SHAPES)
def test_html_is_linear(shape):
    """Twice the page takes about twice the time."""

    def took(n):
        page = shape * n if isinstance(shape, str) else shape[0] * n + shape[1] * n
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            html_text.main_text(page)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(20_000) < 5 * took(10_000) + 0.05


def test_html_odd_markup():
    assert html_text.main_text('<p>a <b title="x>y">bold</b> b') == "a bold b"
    assert html_text.main_text('<p>first <a href="x>link</a> and <i>on</i> it goes') == "first link and on it goes"
    assert html_text.main_text("<p>one<p>two <!-- never ends <p>three") == "one\ntwo"
    assert html_text.main_text("a < b and c > d <e") == "a < b and c > d <e"
    assert html_text.main_text("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a\nb\nc"
    assert html_text.main_text("<p>x, y<b><i>z</p><p>w, v") == "x, yz\nw, v"


def test_html_query(spark):
    got = {r.page_id: r for r in queries.QUERIES["op4_tree_scoring"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_odd_rows(spark):
    long = "<p>" + "word, " * 400_000 + "</p>"
    assert html_text.main_text(f"<main>{long}{ARTICLE}</main>").startswith("word, word") and len(html_text.main_text(long)) == 6 * 400_000 - 1
    rows = [(1, None, None), (1, None, None), (None, "u", f"<body>{ARTICLE}"), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0)] * 3 + [(WANT, len(WANT))]
    assert html_text.extract(pages.limit(0)).count() == 0


def plain_signatures(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [(w, i == 0 or words[i - 1] in spotsigs.ANCHORS) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    return {" ".join(w for w, _ in content[i : i + 3]) for i, (_, after) in enumerate(content) if after or i == 0} or {"#" + (text or "").lower()}


def test_spotsigs_match_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in spotsigs.probe(spark.read.parquet(f"{SF}/documents.parquet"), per_bucket=7).collect()}
    assert len(got) == len(docs)
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = map(plain_signatures, (text, edited, after))
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        assert len(r.fingerprint) == 8 * len(a) and len(r.edited_fingerprint) == 8 * len(b)


def test_spotsigs_odd_rows(spark):
    rows = [(3, LONG), (1, None), (1, ""), (None, "the of"), (2, "of the"), (2, "of the"), (9, "¡¿ !!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sigs", "2 as key", "3 as ghost", "4 as next_text")
    got = spotsigs.probe(docs, per_bucket=2).collect()
    assert len(got) == 7
    same = [r for r in got if r.doc_id == 2]
    assert same[0].fingerprint == same[1].fingerprint and {r.near_next for r in same} >= {1.0}
    assert spotsigs.probe(docs.limit(0)).count() == 0
    lone = spotsigs.probe(docs.filter("doc_id = 9")).collect()
    assert [(r.near_next, r.n_chars) for r in lone] == [(1.0, 5)]
    stops = spark.createDataFrame([(1, "the " * 100_000 + "end")], "doc_id long, text string")
    assert spotsigs.probe(stops).first().n_chars == 400_003


def covering_signatures(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [(k, w) for k, w in enumerate(words) if w not in spotsigs.ANCHORS]
    runs = []
    for i, (k, _) in enumerate(content):
        if i and content[i - 1][0] == k - 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    starts = [i for r in runs for i in (r if len(r) > spotsigs.RUN else r[:1])]
    return {" ".join(w for _, w in content[i : i + 3]) for i in starts} or {"#" + (text or "").lower()}


def test_spotsigs_query_covers_long_runs(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op9_spotsigs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        a, b, c = map(covering_signatures, (text, text[: len(text) - cut] + after[:cut], after))
        assert got[d].near_edited == pytest.approx(len(a & b) / len(a | b)) and got[d].near_next == pytest.approx(len(a & c) / len(a | c))
        assert len(got[d].fingerprint) == 8 * len(a) and len(got[d].edited_fingerprint) == 8 * len(b)


def test_spotsigs_without_anchors(spark):
    rows = [(i, "\n".join(f"| r{i}x{j} | v{i}x{j} |" for j in range(100))) for i in range(4)]
    rows += [(8, " ".join(f"w{j}" for j in range(9))), (9, " ".join(f"w{j}" for j in range(10))), (10, "the " + "\n".join(f"{j} the" for j in range(9)))]
    got = {r.doc_id: r for r in spotsigs.probe(spark.createDataFrame(rows, "doc_id long, text string"), run=spotsigs.RUN).collect()}
    assert all(len(got[i].fingerprint) == 8 * 200 and 0.55 < got[i].near_edited < 0.75 and got[i].near_next == 0 for i in range(3))
    assert [len(got[i].fingerprint) // 8 for i in (8, 9, 10)] == [1, 10, 9]


def test_spotsigs_query_is_native(spark):
    plan = queries.QUERIES["op9_spotsigs"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_inherit(rows):
    """path -> (license, how) from path -> own licence."""
    held = {}
    for p, own in rows.items():
        if own and re.search(licenses.LICENCE_FILE, p.rsplit("/", 1)[-1]):
            held.setdefault(p.rpartition("/")[0], []).append((p, own))
    out = {}
    for p, own in rows.items():
        up = p.rpartition("/")[0]
        while own is None and up not in held and up:
            up = up.rpartition("/")[0]
        out[p] = (own, "own") if own else (min(held[up])[1], "inherited") if up in held else (None, "none")
    return out


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    full = licenses.TEMPLATES["MIT"][2]
    texts = {
        "a/LICENSE": "Copyright (c) 2020 Someone\n\n" + full, "a/x.txt": "nothing here", "a/b/y.txt": "words " * 50 + mit + " words" * 50, "a/b/c/COPYING": gpl,
        "a/b/c/d/z.txt": "text", "e/q.txt": "All rights reserved.", "LICENSE": "Licensed under CC BY-NC 4.0.", "r.txt": "driver licence renewal office", "e/f/g.txt": "",
    }
    files = spark.createDataFrame([*texts.items(), (None, mit), ("n.txt", None), ("n.txt", None)], "path string, text string").selectExpr("*", "1 as license", "2 as how", "'k' as kept")
    got = [(r.path, r.license, r.how) for r in licenses.scan(files).collect()]
    own = {"a/LICENSE": "MIT", "a/b/y.txt": "MIT", "a/b/c/COPYING": "GPL-3.0", "e/q.txt": "Proprietary", "LICENSE": "CC-BY-NC-4.0"}
    want = plain_inherit({p: own.get(p) for p in texts})
    assert {(p, g, h) for p, g, h in got if p in texts} == {(p, *v) for p, v in want.items()}
    assert [(g, h) for p, g, h in got if p is None] == [("MIT", "own")] and len(got) == len(texts) + 3
    assert licenses.scan(files.limit(0)).count() == 0


WRAPPED = [
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT\nLicense."),
    ("GPL-3.0", "This work is licensed under the GNU General Public\nLicense, version 3."),
    ("Unlicense", "This is free and unencumbered software released into the\npublic domain."),
    ("Apache-2.0", "Licensed under the Apache\nLicense, Version 2.0."),
    *[(name, textwrap.fill(text, width)) for width in (40, 72, 80) for name, texts in licenses.TEMPLATES.items() for text in texts],
]


@pytest.mark.parametrize("lead", ["", " * ", "# ", "// "])
def test_wrapped_notices(lead):
    scorer = licenses.Scorer({}, 10_000)
    before, after = "Parser of tables and other things that files hold\nFile 7 of the project\n\n", "\n\nimport os\nimport sys\nprint(os.name)\n" * 9
    for name, notice in WRAPPED:
        score, found = scorer.scan("src/x.c", "\n".join(lead + line for line in (before + notice + after).split("\n")))
        assert found == name and score >= licenses.THRESHOLD, (name, notice, found, score)


def test_spdx_tags():
    scorer = licenses.Scorer({}, 10_000)
    said = {"MIT": "MIT", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0+": "GPL-2.0", "(Apache-2.0 OR MIT)": "Apache-2.0", "BSD-3-Clause": "BSD-3-Clause", "cc0-1.0": "CC0-1.0"}
    assert {tag: scorer.scan("x.c", f"// SPDX-License-Identifier: {tag}\nint x;") for tag in said} == {tag: (1.0, name) for tag, name in said.items()}
    assert scorer.scan("x.c", "// SPDX-License-Identifier: Ruby\nint x;")[0] < licenses.THRESHOLD


def test_kinds_of_bsd_and_weak_notices():
    scorer = licenses.Scorer({}, 10_000)
    own = "Copyright (c) 2020, The Someone Project. All rights reserved.\n\n"
    two, three = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    two, three = (t.replace("COPYRIGHT HOLDERS AND", "REGENTS AND") for t in (two, three))
    for lead in ("", "# "):
        wrap = lambda t, lead=lead: "\n".join(lead + x for x in textwrap.wrap(own + t, 76))
        assert scorer.scan("LICENSE", wrap(two))[1] == "BSD-2-Clause"
        assert scorer.scan("a.c", wrap(three) + "\nint main() {}\n" * 50)[1] == "BSD-3-Clause"
    assert scorer.scan("a.c", "Licensed under the BSD 2-Clause License")[1] == "BSD-2-Clause"
    assert scorer.scan("a.c", own)[1] == "Proprietary"
    assert scorer.scan("a.c", licenses._BSD_HEAD)[1] == "BSD"
    assert scorer.scan("LICENSE", own + licenses._MIT_HEAD + licenses._MIT_TAIL)[1] == "MIT"
    assert scorer.scan("COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + "preamble words " * 900 + "version 3 of the GNU Affero General Public License")[1] == "GPL-3.0"
    long = "word " * 400_000 + "\nReleased under the MIT License.\n" + "word " * 100_000
    assert scorer.scan("a.c", long) == (1.0, "MIT")
    assert scorer.scan("a.c", "Licensed under CC BY 4.0. Released under the MIT License.") == (1.0, "CC-BY-4.0")  # a tie: the first by name


def test_license_score_is_the_cosine():
    import math

    frequency = {"released": 50, "under": 900, "the": 1000, "mit": 3, "license": 20}
    scorer = licenses.Scorer(frequency, 1000)
    idf = lambda w: math.log(1001 / (1 + frequency.get(w, 0))) + 1
    said, known = "issued under the mit license".split(), "released under the mit license".split()
    dot = sum(idf(w) ** 2 for w in said if w in known)
    want = dot / math.sqrt(sum(idf(w) ** 2 for w in known)) / math.sqrt(sum((idf(w) if w in known else scorer.rarest) ** 2 for w in said))
    got = scorer.cosines(said)
    assert max(got[k] for k, name in enumerate(scorer.templates) if name == "MIT") == pytest.approx(want)


def test_license_query(spark):
    rows = queries.QUERIES["op1_license_scan"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    names = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "All rights reserved": "Proprietary"}
    for r in rows:
        said = {v for k, v in names.items() if k.lower() in texts[r.doc_id].lower()}
        assert (r.own_license in said) if said else r.own_license is None
    want = plain_inherit({r.path: r.own_license for r in rows})
    assert {r.path: (r.license, r.how) for r in rows} == want
    assert any(r.how == "inherited" for r in rows)


def test_similar_matches_brute_force(spark):
    """Classes and links of all documents, near copies of them, and copies."""
    import random

    rng = random.Random(2)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts[:60]:
        words = t.split(" ")
        for share in (0.01, 0.03, 0.08):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in words))
    texts += texts[:5] + ["the same rare words here"] * 30 + [f"of boiler {i % 3} plate for all of the many texts" for i in range(40)]
    sets = [frozenset(covering_signatures(t)) for t in texts]
    first, want = {}, {}
    for i, x in enumerate(sets):
        first.setdefault(x, i)
    distinct = list(first)
    for x in distinct:
        want[x] = sum(1 for y in distinct if y != x and len(x & y) >= 0.8 * len(x | y) - 1e-12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.similar(docs).collect()}
    assert got == {i: (first[x], want[x]) for i, x in enumerate(sets)} and sum(want.values()) > 50
    tiled = {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.similar(docs, tile=3).collect()}
    assert tiled == got
    plan = spotsigs.similar(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_similar_odd_rows(spark):
    rows = [(3, LONG), (1, None), (None, ""), (None, "the of"), (2, "of the"), (2, "of the"), (9, "¡¿ !!"), (9, "¡¿ !!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sid", "2 as sigs", "3 as rows", "4 as n")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in spotsigs.similar(docs).collect()), key=str)
    assert got == sorted([(3, 3, 0), (1, 1, 0), (None, 1, 0), (None, None, 0), (2, 2, 0), (2, 2, 0), (9, 9, 0), (9, 9, 0)], key=str)
    assert spotsigs.similar(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spotsigs.similar(docs, likeness_=0)


@pytest.mark.parametrize("kind", ["long", "string", "double", "date", "decimal(20,2)", "hot", "nulls", "wide", "shared"])
def test_next_row_by_any_id(spark, kind):
    import random

    rng = random.Random(4)
    ids = [rng.randrange(-500, 500) for _ in range(400)]
    if kind == "hot":
        ids = [7 if rng.random() < 0.5 else i for i in ids]
    elif kind == "wide":
        ids = [(1 << 62) + i // 3 for i in ids]
    elif kind == "nulls":
        ids = [None if rng.random() < 0.5 else i for i in ids]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    if kind == "shared":
        docs = docs.selectExpr("concat('http://one/', lpad(doc_id + 600, 8, '0')) as doc_id", "text")
    elif kind == "date":
        docs = docs.selectExpr("date_add(date'2020-01-01', cast(doc_id as int)) as doc_id", "text")
    elif kind not in ("hot", "wide", "nulls"):
        docs = docs.selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    rows = sorted(((r.doc_id is not None, r.doc_id, r.h, r.text) for r in docs.selectExpr("*", "xxhash64(text) as h").collect()), key=lambda r: r[:3] if r[0] else (False, 0, r[2]))
    want = {r[3]: rows[(k + 1) % len(rows)][3] for k, r in enumerate(rows)}
    for per in (3, 50, 10_000):
        got = spotsigs.with_next(docs, per_bucket=per).collect()
        assert len(got) == 400 and {r.text: r.next_text for r in got} == want, per
