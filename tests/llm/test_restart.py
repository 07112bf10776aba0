"""States that a second run continues, through to the result."""

from hinflow.llm import exact
from hinflow.streaming.sketch_stream import SketchTable, edge_sketch


def test_exact_groups_continue_a_state(spark, tmp_path):
    first = [(1, "Same"), (2, "only first"), (9, "late"), (3, None), (4, "same")]
    second = [(5, "SAME"), (6, "LATE"), (7, "only second"), (8, ""), (6, "late")]
    got = []
    for k, rows in enumerate((first, second)):
        path = str(tmp_path / f"table {k}")
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
        found = exact.exact_groups(spark, spark.read.parquet(path), checkpoint=str(tmp_path / "state")).collect()
        got.append(sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in found))
    assert got[0] == [(1, 4, 2, False), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 2, True), (9, 9, 1, True)]
    assert got[1] == [(5, 5, 3, True), (6, 9, 3, False), (6, 9, 3, False), (7, 7, 1, True), (8, 8, 2, True)]


def test_sketch_table_after_a_restart(spark, tmp_path):
    folder, source, checkpoint = (str(tmp_path / n) for n in ("sketch", "edges", "state"))
    schema = "src long, dst long"
    for k in range(2):
        spark.createDataFrame([(1, 10 * k + j) for j in range(6)], schema).write.mode("append").parquet(source)
        table = SketchTable(spark, folder, 4)  # as a new driver makes it
        table.follow(spark.readStream.schema(schema).parquet(source), checkpoint).awaitTermination()
    whole = edge_sketch(spark.read.parquet(source), 4)
    assert sorted(map(tuple, SketchTable(spark, folder, 4).read().collect())) == sorted(map(tuple, whole.collect()))
