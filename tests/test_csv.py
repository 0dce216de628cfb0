import pandas as pd

from tidewise.sources.tables import read_table

TEXT = 'a,b,c\n1,"x ""q"" y","first\nsecond"\n2,NA,\n3," pad ","plain, comma"\n'


def test_quotes_and_line_breaks_as_pandas_reads_them(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(TEXT)
    want = pd.read_csv(path, dtype=str)
    got = read_table(spark, str(path)).toPandas()
    assert list(got.columns) == list(want.columns)
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def test_round_trip_of_a_table(spark, tmp_path):
    """Documents (quotes, line breaks, accents) written by Spark and read back."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "docs")
    docs.write.option("header", True).option("escape", '"').csv(path)
    got = {r.doc_id: r.text for r in read_table(spark, path).collect()}
    want = {str(r.doc_id): r.text for r in docs.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] for k in want)
