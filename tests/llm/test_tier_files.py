"""Files of the tiered index: what a task holds at once doesn't grow with the segments of its file."""

from pathlib import Path

import pyarrow.parquet as pq

from codeweave.llm import tiers


def test_a_row_group_is_a_segment(spark, tmp_path):
    docs = [(k, " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(300))) for k in range(60)]
    index = tiers.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), segment_bytes=8 << 10)
    files = [pq.ParquetFile(p).metadata for p in Path(index.segments.removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) > 5 and max(groups) == 1
