import json

import pytest

from proofline.sources import config, inventory, markdown, stext, summaries
from proofline.sources.ocr_rows import load_ocr_rows
from proofline.operators.pages import page_text

SCHEMA = "raw_id long, pdf string, page int, line_no int, dialect string, raw_line string, clash string"
HEAD = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"


def kinds(text):
    return [(u.kind, u.text, u.line, u.column) for u in markdown.parse_units(text)]


def test_markdown_units():
    text = "# Title\n\nA *b* `c d` [link](x \"t\") ![img](y)\nnext<br>line &amp; \\*s\n\n- item one\n- [x] done\n\n> quoted\n> more\n\n| a | b |\n|---|---|\n| 1 | **2** |\n\n```py\ncode  x\n```\n\n<div>no</div>\n\nSub\n---\ntail"
    got = kinds(text)
    assert ("heading", "Title", 1, 1) in got
    assert ("paragraph", "A b c d link next line & *s", 3, 1) in got
    assert ("list_item", "item one", 6, 3) in got and ("list_item", "[x] done", 7, 3) in got
    assert ("blockquote", "quoted more", 9, 3) in got
    assert ("table_cell", "a", 12, 3) in got and ("table_cell", "2", 14, 7) in got
    assert ("code_block", "code x", 16, 1) in got
    assert ("heading", "Sub", 22, 1) in got and ("paragraph", "tail", 24, 1) in got
    assert not any("no" == t for _, t, _, _ in got)


def test_markdown_sections():
    units = markdown.parse_units("# A\n## B\ntext\n# C\nmore")
    assert [u.section for u in units] == [[], ["A"], ["A", "B"], [], ["C"]]
    assert markdown.parse_units("") == []


def test_tight_nested_list_takes_first_child_along():
    assert kinds("- parent\n  - child\n  - two")[0][:2] == ("list_item", "parentchild")


def test_stext():
    xml = '<document><page><block bbox="0 0 1 1"><line bbox="1 2 4 6" text="a-"/><line text="b"/></block><block><line text=" "/></block></page></document>'
    page = stext.parse_document(xml)[0]
    assert page["text"] == "ab" and page["blocks"] == ["ab"] and page["spans"][0]["bbox"] == {"x": 1, "y": 2, "width": 3, "height": 4}
    for bad in ("<document/>", "<page/>", "<document><page><line text='x'/></page></document>", "<document><page><block><line/></block></page></document>", "x"):
        with pytest.raises(stext.StextError):
            stext.parse_document(bad)
    assert stext.parse_version("mutool version 1.28.1-x") == (1, 28, 1) and stext.version_in("v 5.5.0", (5, 5), (5, 6))


def test_config(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "proofline.yaml").write_text("coverage: {words: off, tokens: warn}\ncorpus: {pdf: 'p/{id}.pdf'}\n")
    (tmp_path / "a").mkdir()
    cfg, root = config.load(tmp_path / "a")
    assert root == tmp_path.resolve() and cfg.coverage.tokens == "warn" and cfg.corpus.sources["default"].pdf == "p/{id}.pdf"
    for bad in ({"nope": 1}, {"corpus": {"summaries": "x"}}, {"corpus": {"summaries": "../{id}"}}, {"pdf": {"ocr": {"dpi": 0}}}, {"coverage": {"words": "loud"}}, {"corpus": {"sources": {}}}, {"terms": {"claim": "x", "claims": "x"}}):
        with pytest.raises(config.ConfigError):
            config.decode(bad)


def test_summary_documents():
    text = """
id: abc
facts: [One thing.]
evidence:
  markdown: {source: md/abc.md, sha256: x}
  pdf: {source: pdfs/abc.pdf, sha256: y}
  facts:
  - fact: 0
    fact_sha256: z
    locators: [{exact: thing, pdf: {page: 1, backend: mutool-native}}]
review: {facts: [{fact: 0, fact_sha256: z, evidence_sha256: e, verdict: partial, reviewer: r, at: 2026-01-02}]}
"""
    doc = summaries.parse_summary(text, config.Terms("fact", "facts"))
    assert doc["sources"][0]["name"] == "default" and doc["entries"][0]["locators"][0]["source"] == "default"
    assert doc["reviews"][0]["at"] == "2026-01-02"
    for bad in ("[]", "id: a\nclaims: 3", "id: abc\nclaims: []\nevidence: {extra: 1}", "id: abc\nclaims: []\nevidence: {claims: [{claim: 0, claim_sha256: x, locators: [{exact: e, pdf: {page: 0, backend: mutool-native}}]}]}", ": :"):
        with pytest.raises(summaries.SummaryError):
            summaries.parse_summary(bad)


def test_ids_of_a_folder(tmp_path):
    (tmp_path / "summaries").mkdir()
    for name in ("b.yaml", "a.yaml", ".h.yaml", "c.txt"):
        (tmp_path / "summaries" / name).write_text("x")
    assert inventory.summary_ids(tmp_path, "summaries/{id}.yaml") == ["a", "b"]
    assert inventory.summary_ids(tmp_path, "none/{id}.yaml") == []
    (tmp_path / "summaries" / "deep").mkdir()
    with pytest.raises(inventory.InventoryError):
        inventory.summary_ids(tmp_path, "summaries/{id}.yaml")


def rows(*lines, dialect="plain"):
    return [(i, "f", 1, i, dialect, line, "z") for i, line in enumerate(lines, 1)]


def test_ocr_rows(spark):
    ok = "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t96.5\t"
    data = rows("\ufeff" + HEAD + "\r", ok + "word\r", ok + 'a"b', "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1", "5\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1", None, "  ", ok + "x\ty", ok.replace("96.5", "-2") + "x", ok.replace("96.5", " 9") + "x", "６" + ok[1:] + "x", ok + "two\nlines\ue000\ue001", ok)
    valid, bad = load_ocr_rows(spark.createDataFrame(data + data[:4], SCHEMA))
    reasons = {r["raw_id"]: r["reason"] for r in bad.collect()}
    assert reasons == {5: "column_count", 6: "column_count", 7: "column_count", 8: "column_count", 9: "value", 10: "value", 11: "value"}
    texts = {r["raw_id"]: r["text"] for r in valid.collect()}
    assert texts == {2: "word", 3: 'a"b', 4: None, 12: "two\nlines\ue000\ue001", 13: ""}


def test_ocr_rows_quoted(spark):
    ok = "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t96.5\t"
    data = rows(HEAD, ok + '"a\tb ""c"""', ok + '"open', ok + 'x"y', ok + '"a" b', ok + "plain", dialect="quoted")
    valid, bad = load_ocr_rows(spark.createDataFrame(data, SCHEMA))
    assert {r["raw_id"]: r["text"] for r in valid.collect()} == {2: 'a\tb "c"', 6: "plain"}
    assert {r["reason"] for r in bad.collect()} == {"quoting"} and bad.count() == 3


def test_ocr_rows_long_and_empty(spark):
    ok = "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t96.5\t"
    valid, bad = load_ocr_rows(spark.createDataFrame(rows(HEAD, ok + "w" * 300_000), SCHEMA))
    assert valid.selectExpr("length(text)").first()[0] == 300_000 and bad.isEmpty()
    valid, bad = load_ocr_rows(spark.createDataFrame([], SCHEMA))
    assert valid.isEmpty() and bad.isEmpty()


def test_page_text(spark):
    data = [("f", 1, n, b, 1, li, c, t) for n, b, li, c, t in ((2, 1, 1, 90.0, "a"), (3, 1, 1, -1.0, "b"), (4, 1, 2, 70.0, "c"), (5, None, 2, 80.0, "d"), (6, 1, 2, 10.0, "  "))]
    df = spark.createDataFrame(data, "pdf string, page int, line_no int, block_num long, par_num long, line_num long, conf double, text string")
    r = page_text(df).first()
    assert r["text"] == "a b\nc\nd" and r["mean_confidence"] == 80.0 and r["words"] == 4


def test_folder_end_to_end(spark, tmp_path):
    import hashlib

    from proofline.plans.check import check

    for d in ("summaries", "md", "pdfs"):
        (tmp_path / d).mkdir()
    (tmp_path / "md/abc.md").write_text("# T\n\nThe yield rose by 13 percent.\n")
    (tmp_path / "pdfs/abc.pdf").write_bytes(b"%PDF")
    (tmp_path / "pdfs/abc.xml").write_text('<document><page><block><line text="The yield rose by 13 percent."/></block></page></document>')
    sha = lambda b: hashlib.sha256(b).hexdigest()
    claim = "Yield rose 13 percent."
    doc = {
        "id": "abc", "claims": [claim],
        "evidence": {"markdown": {"source": "md/abc.md", "sha256": sha((tmp_path / "md/abc.md").read_bytes())}, "pdf": {"source": "pdfs/abc.pdf", "sha256": "0" * 64},
                     "claims": [{"claim": 0, "claim_sha256": sha(claim.encode()), "locators": [{"exact": "rose by 13 percent", "markdown": {"line": 3, "column": 1, "unit": "paragraph", "section": ["T"]}, "pdf": {"page": 1, "backend": "mutool-native"}}]}]},
    }
    (tmp_path / "summaries/abc.yaml").write_text(json.dumps(doc))
    (tmp_path / "summaries/bad.yaml").write_text("nothing")
    corpus, broken = inventory.from_folder(spark, tmp_path, config.Config())
    done = check(corpus, config.Config(), parse_issues=broken)
    assert sorted(r["code"] for r in done.issues.collect()) == ["source_hash_mismatch", "summary_parse_failed"]
    assert done.legs.first()["legs"] == ["pdf", "default"]


def test_paths_that_cannot_be_read(tmp_path):
    root = (tmp_path / "corpus").resolve()
    root.mkdir()
    (tmp_path / "far.pdf").write_bytes(b"x")
    (root / "near.pdf").write_bytes(b"x")
    (root / "folder").mkdir()
    (root / "link.pdf").symlink_to(tmp_path / "far.pdf")
    got = {p: inventory.path_state(root, p) for p in ("near.pdf", "link.pdf", "../far.pdf", "../none.pdf", "none.pdf", "folder")}
    assert got == {"near.pdf": None, "link.pdf": "outside", "../far.pdf": "outside", "../none.pdf": "outside", "none.pdf": "missing", "folder": "unreadable"}


def test_commands_on_a_folder(spark, tmp_path, capsys):
    import hashlib

    from proofline import cli

    for d in ("summaries", "pdfs"):
        (tmp_path / d).mkdir()
    (tmp_path / "proofline.yaml").write_text("corpus: {sources: {default: {markdown: ['md/{id}.md'], pdf: 'pdfs/{id}.pdf'}, annex: {markdown: null, pdf: 'pdfs/{id}-annex.pdf'}}}\n")
    for name in ("abc", "abc-annex"):
        (tmp_path / f"pdfs/{name}.pdf").write_bytes(b"%PDF " + name.encode())
        (tmp_path / f"pdfs/{name}.xml").write_text('<document><page><block><line bbox="1 2 4 6" text="The yield rose by 13 percent."/></block></page></document>')
    claim = "Yield rose 13 percent."
    sha = lambda p: hashlib.sha256((tmp_path / p).read_bytes()).hexdigest()
    sources = [{"name": "annex", "pdf": {"source": "pdfs/abc-annex.pdf", "sha256": sha("pdfs/abc-annex.pdf")}}]
    (tmp_path / "summaries/abc.yaml").write_text(json.dumps({"id": "abc", "claims": [claim], "evidence": {"sources": {s["name"]: {"pdf": s["pdf"]} for s in sources}, "claims": []}}))
    run = lambda *a: (cli.main(["--root", str(tmp_path), *a]), capsys.readouterr())
    code, said = run("extract", "abc", "--write")
    text = (tmp_path / "md/abc.md").read_text()
    assert code == 0 and text.startswith(f"---\nsource: pdfs/abc.pdf\nsha256: {sha('pdfs/abc.pdf')}\n---\n") and text.endswith("## Page 1\n\nThe yield rose by 13 percent.\n\n")
    assert run("extract", "abc", "--write")[0] == 1 and run("extract", "abc", "--write", "--force")[0] == 0
    assert run("extract", "abc", "--source", "annex", "--write")[0] == 1
    assert [p.name for p in (tmp_path / "md").iterdir()] == ["abc.md"]
    code, said = run("locate", "abc", "--claim", "0", "--source", "annex", "--exact", "rose by 13 percent")
    locator = json.loads(said.out)["locators"][0]
    assert code == 0 and locator["source"] == "annex" and "markdown" not in locator and locator["pdf"]["page"] == 1 and locator["bbox"]["x"] == 1
    assert run("locate", "abc", "--claim", "0", "--source", "annex", "--exact", "rose by 14 percent")[0] == 1
    assert run("locate", "abc", "--claim", "7", "--source", "annex", "--exact", "rose by 13 percent")[0] == 1
