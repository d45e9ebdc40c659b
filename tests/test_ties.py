"""Rows that are equal to an ORDER BY: the first of the table is kept, however the table is split."""

import pyarrow as pa
import pyarrow.parquet as pq

from tracewell.plans.findings_queries import dedup_rule_line


def test_of_equal_findings_the_first_of_the_table_is_kept(spark, tmp_path):
    items = pq.read_table("/root/testdata/sf0.001/lineitem.parquet").slice(0, 400)
    for name, values in {"l_orderkey": [k % 50 for k in range(400)], "l_linenumber": [1] * 400, "l_suppkey": [3] * 400, "l_quantity": [13.0] * 400, "l_partkey": list(range(400))}.items():
        items = items.set_column(items.schema.get_field_index(name), name, pa.array(values, items.schema.field(name).type))
    (tmp_path / "lineitem.parquet").mkdir()
    # The later file is the larger one, which Spark reads first.
    pq.write_table(items.slice(0, 120), tmp_path / "lineitem.parquet" / "part-0.parquet")
    pq.write_table(items.slice(120), tmp_path / "lineitem.parquet" / "part-1.parquet", row_group_size=70)
    found = dedup_rule_line(spark, str(tmp_path))
    assert "place" not in found.columns
    first = items.slice(0, 50).to_pydict()
    want = {(f"src/f{k}.py", d * 10) for k, d in zip(first["l_orderkey"], first["l_discount"], strict=True)}
    assert {(r.file_path, r.confidence_score) for r in found.collect()} == want and found.count() == 50
