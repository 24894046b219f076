"""Names, listings, readers, writers, registry and requests."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from folioscore.operators import registry
from folioscore.plans.evaluate import evaluate_all
from folioscore.sources import files, naming, sinks


def column(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", expr(F.col("v"))).orderBy("i").collect()]


@pytest.mark.unit
def test_output_names(spark):
    df = spark.createDataFrame(
        [
            (0, "in/a.b.pdf", "openai", "gpt-4o"),
            (1, "/x/doc.PDF", "textract", ""),
            (2, "doc", "mistral", None),
            (3, ".hidden", "openai", None),
        ],
        "i int, p string, parser string, model string",
    ).orderBy("i")
    got = df.select(naming.output_name(F.col("p"), F.col("parser"), F.col("model"))).collect()
    assert [r[0] for r in got] == [
        "a.b_openai_gpt-4o.md",
        "doc_textract.md",
        "doc_mistral.md",
        ".hidden_openai.md",
    ]


@pytest.mark.unit
def test_labels(spark):
    assert column(spark, naming.variant_label, "out/doc_openai_gpt-4o.md", "a_b_openai.md", "x.md") == [
        "openai_gpt-4o",
        "b_openai",
        "x",
    ]
    assert column(
        spark,
        naming.axis_label,
        "output/doc_openai_gpt-4o.md",
        "output/doc_openai.md",
        "output/doc_textract.md",
        "plain.md",
    ) == ["openai_gpt-4o", "output/doc_openai", "textract", "plain"]


@pytest.mark.unit
def test_validate_inputs(spark):
    requested = spark.createDataFrame(
        [(p,) for p in ("no.txt", "dir.pdf", "dir.txt", "a.txt", "a.pdf", "b.PDF", ".pdf")], "path string"
    )
    listing = spark.createDataFrame(
        [("dir.pdf", False), ("dir.txt", False), ("a.txt", True), ("a.pdf", True), ("b.PDF", True), (".pdf", True)],
        "path string, is_file boolean",
    )
    got = {r["path"]: r["verdict"] for r in files.validate_inputs(requested, listing).collect()}
    assert got == {
        "no.txt": "missing",
        "dir.pdf": "not a file",
        "dir.txt": "not a file",
        "a.txt": "wrong suffix",
        "a.pdf": "ok",
        "b.PDF": "ok",
        ".pdf": "wrong suffix",
    }


@pytest.mark.integration
def test_validate_against_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "sub" / "b.txt").write_bytes(b"y")
    names = ["a.pdf", "sub", "sub/b.txt", "gone.pdf"]
    requested = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "path string")
    got = files.validate_inputs(requested, files.list_inputs(spark, str(tmp_path)))
    assert {r["path"].removeprefix(f"{tmp_path}/"): r["verdict"] for r in got.collect()} == {
        "a.pdf": "ok",
        "sub": "not a file",
        "sub/b.txt": "wrong suffix",
        "gone.pdf": "missing",
    }


@pytest.mark.unit
def test_encode_payload(spark):
    data = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    plain, uri = df.select(
        files.encode_payload(F.col("content")), files.encode_payload(F.col("content"), files.PNG_URI)
    ).first()
    assert plain == base64.b64encode(data).decode()
    assert uri == "data:image/png;base64," + plain


@pytest.mark.integration
def test_read_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1.4 y")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = files.scan_documents(spark, str(tmp_path)).select(files.encode_payload(F.col("content")))
    rows = [r[0] for r in got.collect()]
    assert len(rows) == 2 and all(r.startswith("JVBERi0x") for r in rows)


@pytest.mark.integration
def test_scan_and_evaluate_folder(spark, tmp_path):
    out = tmp_path / "output"
    out.mkdir()
    names = ["doc_openai_gpt-4o.md", "doc_anthropic.md", "doc_openai.md", "doc_textract.md"]
    for i, name in enumerate(names):
        (out / name).write_text(f"# Title\n\n**word{i}** shared é\n", encoding="utf-8")
    (out / "other_openai.md").write_text("alone")
    (out / "doc_pandoc.md").write_text("not asked")
    found = files.scan_variants(spark, str(out), "doc")
    rows = [(r["ord"], r["file"].rsplit("/", 1)[1]) for r in found.orderBy("ord", "file").collect()]
    assert rows == [
        (0, "doc_anthropic.md"),
        (3, "doc_openai.md"),
        (3, "doc_openai_gpt-4o.md"),
        (5, "doc_textract.md"),
    ]
    assert found.where("parser = 'textract'").first()["text"] == "# Title\n\n**word3** shared é\n"
    with pytest.raises(ValueError, match="No files found"):
        files.scan_variants(spark, str(out), "absent")

    results = tmp_path / "results"
    for strip in (True, False):
        long_rows, matrix = evaluate_all(spark, str(out), str(results), strip=strip)
        assert long_rows.count() == 6 * (10 + 1)
        assert matrix.where("filestem = 'doc'").count() == 6 * 4
    saved = spark.read.option("header", True).csv(str(results / "metrics"))
    assert saved.columns[:4] == ["Metric", "File1", "File2", "Value"]
    assert {r["mode"]: r["count"] for r in saved.groupBy("mode").count().collect()} == {
        "stripped": 66,
        "with Markdown": 66,
    }


@pytest.mark.integration
def test_names_in_the_saved_metrics(spark, tmp_path):
    out = tmp_path / "odd names"
    out.mkdir()
    names = [
        "my doc_anthropic.md", "my doc_openai.md", "50%_a+b_mistral.md", "\u00fcber_textract.md",
        "report_openai_study_anthropic.md", "report_openai_study_openai_o1.md",
    ]
    for name in names:
        (out / name).write_text("same words here", encoding="utf-8")
    stems = {
        "my doc": ["my doc_anthropic.md", "my doc_openai.md"], "50%_a+b": ["50%_a+b_mistral.md"],
        "\u00fcber": ["\u00fcber_textract.md"],
        "report_openai_study": ["report_openai_study_anthropic.md", "report_openai_study_openai_o1.md"],
    }
    found = files.scan_all_variants(spark, str(out)).collect()
    assert {(r["filestem"], r["file"]) for r in found} == {(s, f) for s, fs in stems.items() for f in fs}
    given = spark.createDataFrame([("report",), ("my doc",)], "filestem string")
    asked = files.scan_all_variants(spark, str(out), stems=given).collect()
    assert {(r["filestem"], r["parser"]) for r in asked} == {
        ("report", "openai"), ("my doc", "anthropic"), ("my doc", "openai"),
    }
    assert files.scan_variants(spark, str(out), "my doc").count() == 2
    evaluate_all(spark, str(out), str(tmp_path / "results"), strip=False)
    saved = spark.read.option("header", True).csv(str(tmp_path / "results" / "metrics")).collect()
    assert len(saved) == 6 * (3 + 1 + 1 + 3)
    pairs = {(r["File1"], r["File2"]) for r in saved}
    assert ("my doc_anthropic.md", "my doc_openai.md") in pairs and ("50%_a+b_mistral.md",) * 2 in pairs
    assert {float(r["Value"]) for r in saved if r["Metric"] == "word_overlap"} == {1.0}


@pytest.mark.integration
def test_saved_markdown_is_replaced_by_key(spark, tmp_path):
    schema = "filestem string, parser string, model string, markdown string"
    path = str(tmp_path / "md")
    first = [("d", "openai", "o1", "x\n\ny"), ("e", "openai", "o1", "z"), ("d", "textract", "", "t")]
    sinks.write_markdown(spark.createDataFrame(first, schema), path)
    sinks.write_markdown(spark.createDataFrame([("d", "openai", "o1", "new")], schema), path)
    got = {tuple(r) for r in sinks.read_saved(spark, path).collect()}
    assert got == {("d", "openai", "o1", "new"), ("e", "openai", "o1", "z"), ("d", "textract", "", "t")}
    text = str(tmp_path / "text")
    sinks.write_markdown_files(spark.createDataFrame([("d", "openai", "o1", "x\n\ny é\n\n")], schema), text)
    assert spark.read.text(text, wholetext=True).first()["value"] == "x\n\ny é\n\n"


@pytest.mark.unit
def test_registry_and_jobs(spark):
    listed = {r["parser"]: r for r in registry.list_registry(spark).collect()}
    assert len(listed) == 8
    assert listed["googleai"]["models"].startswith("gemini-1.5-flash, gemini-2.0-flash, ")
    assert listed["googleai"]["default_model"] == "gemini-2.0-flash"
    assert listed["textract"]["models"] == "" and listed["textract"]["default_model"] == ""
    jobs = spark.createDataFrame(
        [
            (1, "textract", None),
            (2, "openai", ""),
            (3, "openai", "o1"),
            (4, "openai", "gemini-2.0-flash"),
            (5, "markitdown", None),
            (6, "textract", "x"),
        ],
        "doc_id int, parser string, model string",
    )
    good = {r["doc_id"]: r["model"] for r in registry.resolve_jobs(jobs).collect()}
    assert good == {1: "", 2: "gpt-4o", 3: "o1"}
    bad = {r["doc_id"]: r["reason"] for r in registry.rejected_jobs(jobs).collect()}
    assert bad == {4: "unsupported model", 5: "unsupported parser", 6: "unsupported model"}


@pytest.mark.unit
def test_requests(spark):
    jobs = registry.resolve_jobs(
        spark.createDataFrame(
            [(1, p, None) for p in registry.PARSER_NAMES], "doc_id int, parser string, model string"
        )
    )
    units = spark.createDataFrame([(1, 1, "QUJD")], "doc_id int, page_no int, payload string")
    rows = registry.build_requests(jobs, units, "SYS").collect()
    got = {r["parser"]: json.loads(r["request"]) for r in rows}
    assert got["anthropic"] == {
        "model": "claude-3-7-sonnet-20250219",
        "system": "SYS",
        "prompt": registry.PDF_PROMPT,
        "temperature": 0.1,
        "top_p": 0.1,
        "top_k": 40,
        "max_tokens": 8192,
        "payload": "QUJD",
    }
    assert got["googleai"]["max_output_tokens"] == 65536
    assert got["ollama"]["num_predict"] == 8192
    assert "top_k" not in got["openai"] and "top_k" not in got["huggingface"]
    assert got["openai"]["payload"] == "data:application/pdf;base64,QUJD"
    assert got["huggingface"]["prompt"] == registry.IMAGE_PROMPT
    assert got["textract"] == {"payload": "QUJD"}
