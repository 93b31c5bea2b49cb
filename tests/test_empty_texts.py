"""Queries over documents whose texts are empty, null or hold what a template holds, against their SQL."""

import duckdb
import pytest

from lampwick.plans import registry

from test_queries import plain

ODD = ["", None, "a {{targetField}} {{ocrData}} {{/if}} $1", "İß é😀漢字é", " ", "\r\n b"]
NAMES = ["append_ocr_text", "char_intersect_union", "jaccard_chars", "render_template", "semantic_check_prompt"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(spark, tmp_path, name):
    rows = [(i, ODD[i // 12 % len(ODD)], "en" if i % 5 else "", f"src{i % 3}" if i % 11 else None, 0) for i in range(-12, 12 * len(ODD))] + [(1000 + i, t, None, "src", 0) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(tuple(plain(r[c]) for c in names) for r in got) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
