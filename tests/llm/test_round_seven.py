"""Line hashing takes lower case as its SQL does."""

import duckdb
import pytest

from loomery.llm import line_dedup, queries


def test_lines_fold_letter_by_letter(spark, tmp_path):
    """A sigma at the end of a word and a dotted I are in Java's lower case what they are not in the SQL."""
    tail = "two three four five"
    texts = [f"ΟΔΟΣ {tail}", f"οδοσ {tail}", f"οδος {tail}", f"İX {tail}\nix {tail}", f"i̇x {tail}", f"ΣΣΣ. {tail}\nσσσ. {tail}\nσσς. {tail}", f"ODOS {tail}\r\nodos\t{tail}", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT doc_id, n_lines, n_removed, removed_spans, kept_sha256 FROM ({queries.SQL['op3_line_dedup']})").fetchall())
    assert [r[2] for r in got] == [0, 1, 0, 1, 0, 1, 1, 0]


@pytest.mark.parametrize("unit", sorted(line_dedup.UNITS))
def test_units_fold_letter_by_letter(spark, unit):
    rows = [(1, "ΟΔΟΣ two three four five"), (2, "οδοσ two three four five"), (3, "ΟΔΟΣ two three four five")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 1, 3: 1}
