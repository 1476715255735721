"""The data source: reading relations of files, and committed writing."""

import pytest

from quire.plans import pdfs
from quire.sources import catalog, datasource, pdf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(datasource.PdfSource)
    return spark


@pytest.fixture(scope="module")
def folder(source, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('pdf')}/files"
    made = pdfs.made(source, SF).selectExpr("concat('d', doc_id, '.pdf') AS name", "content")
    made.repartition(5).write.format("pdf").mode("append").save(at)
    return at


def test_files_are_read_as_they_were_written(source, folder, tmp_path):
    ids = "CAST(regexp_extract(path, 'd(\\\\d+)[.]pdf', 1) AS LONG) AS doc_id"
    docs = pdfs.made(source, SF)
    for relation, want in (("documents", pdf.documents(docs, "doc_id")), ("pages", pdf.pages(docs, "doc_id", True)), ("runs", pdf.runs(docs, "doc_id", True)), ("bookmarks", catalog.bookmarks(docs, "doc_id", True))):
        got = source.read.format("pdf").option("relation", relation).option("bytesPerTask", 8 << 20).load(folder)
        assert 8 < got.rdd.getNumPartitions() < 60
        assert sorted(map(str, got.selectExpr(ids, *got.columns[1:]).collect())) == sorted(map(str, want.collect()))
    assert source.read.format("pdf").option("pathGlobFilter", "d7.pdf").load(folder).count() == 1
    with pytest.raises(Exception, match="relation must be"):
        source.read.format("pdf").option("relation", "no").load(folder).collect()
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        source.read.format("pdf").load(f"file://{tmp_path}/nowhere").collect()
    (tmp_path / "empty").mkdir()
    assert source.read.format("pdf").load(f"file://{tmp_path}/empty").collect() == []


def test_a_broken_file_is_an_error_row(source, tmp_path):
    (tmp_path / "no.pdf").write_bytes(pdfs.build(0, "line\n" * 50).replace(b"/DescendantFonts [4 0 R]", b"/DescendantFonts  555555"))
    (tmp_path / "ok.pdf").write_bytes(pdfs.build(1, "some text"))
    (tmp_path / "_hidden.pdf").write_bytes(b"")
    got = {r.path[-6:]: r for r in source.read.format("pdf").option("relation", "runs").load(str(tmp_path)).collect()}
    assert got["no.pdf"].error and got["no.pdf"].text is None
    assert {k for k in got if k != "no.pdf"} == {"ok.pdf"} and got["ok.pdf"].error is None
    assert source.read.format("pdf").option("relation", "runs").load(str(tmp_path)).where("path LIKE '%no.pdf'").count() == 1


def texts(path):
    return sorted(p.read_text() for p in path.rglob("*.txt") if not any(x.startswith("_") for x in p.relative_to(path).parts))


def test_text_files_and_modes(source, tmp_path):
    at = tmp_path / "out"
    rows = [(f"{i}.txt", f"text {i} é") for i in range(20)]
    df = source.createDataFrame(rows, "name string, content string").repartition(4)
    df.write.format("pdf").mode("append").save(str(at))
    assert texts(at) == sorted(t for _, t in rows)
    df.limit(3).write.format("pdf").mode("append").save(str(at))  # the same names in another job stay apart
    assert len(texts(at)) == 23
    df.where("name = '1.txt'").write.format("pdf").mode("overwrite").save(str(at))
    assert texts(at) == ["text 1 é"] and not list(at.glob("_pending*"))
    df.limit(0).write.format("pdf").mode("append").save(str(at))
    assert texts(at) == ["text 1 é"]


@pytest.mark.parametrize("name", ["../up.txt", "a/b.txt", "a\\b", "", None, ".hid", "_x", "c:d", "a\nb", "x" * 300])
def test_names_that_lead_elsewhere_write_nothing(source, tmp_path, name):
    with pytest.raises(ValueError):
        datasource.safe_name(name)
    df = source.createDataFrame([("ok.txt", "x"), (name, "y")], "name string, content string").coalesce(1)
    at = tmp_path / "out"
    if name in ("../up.txt", None):
        with pytest.raises(Exception, match="safe file name"):
            df.write.format("pdf").mode("append").save(str(at))
        assert texts(tmp_path) == [] and not list(at.glob("*"))


def test_attempts_that_spark_does_not_take_leave_nothing(tmp_path):
    """A task that ran twice, one that broke off, and a job that is given up, as Spark calls the writer."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.StringType())])
    writer = datasource.Writer({"path": str(tmp_path / "t")}, schema, False)
    first, again, other = writer.write(iter([{"name": "a.txt", "content": "a"}])), writer.write(iter([{"name": "a.txt", "content": "a"}])), writer.write(iter([{"name": "b.txt", "content": "b"}]))
    with pytest.raises(RuntimeError):
        writer.write(x if x["name"] != "stop" else (_ for _ in ()).throw(RuntimeError()) for x in broken())
    assert texts(tmp_path) == [] and first.folder != again.folder
    writer.commit([again, other, None, writer.write(iter([]))])
    assert texts(tmp_path) == ["a", "b"]
    gone = datasource.Writer({"path": str(tmp_path / "t")}, schema, True)
    gone.abort([gone.write(iter([{"name": "c.txt", "content": "c"}])), None])
    assert texts(tmp_path) == ["a", "b"] and sorted(p.name[:5] for p in (tmp_path / "t").iterdir()) == ["_SUCC", "part-", "part-"]
    with pytest.raises(ValueError):
        datasource.Writer({"path": "x"}, T.StructType([schema.fields[0]]), False)


def broken():
    yield {"name": "x.txt", "content": "x"}
    raise RuntimeError("lost")
