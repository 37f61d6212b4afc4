"""Registered queries next to their SQL, and the pipeline next to plain Python."""

import struct
import sys
import zlib
from pathlib import Path

import pytest
from brute import copies, near_groups, plain, redacted

sys.path.insert(0, str(Path(__file__).parents[1]))

import corpus_pipeline as pipeline
from compare import compare, connect
from trafficlens.llm import catalog, language, packing


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf, name):
    assert compare(catalog.QUERIES[name](spark, sf), connect(sf).sql(catalog.ORACLES[name])) is None


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in catalog.QUERIES}) == list(range(1, 14))


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("table", ["docs", "odd", "empty", "given"])
def test_stages_equal_plain_python(spark, sf, request, table, tmp_path):
    """Each stage against a plain version of it, over all that the stage before has kept."""
    df = spark.read.parquet(f"{sf}/documents.parquet") if table == "given" else request.getfixturevalue(table)
    for name, stage in pipeline.STAGES:
        rows = plain(df)
        out = stage(spark, df, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        if name == "language":
            model = language.fit(df)
            found = language.predict(df.select("doc_id", "text", "lang", "source", "n_chars"), model).collect()
            expected = [tuple(r)[:5] for r in found if not r["rejected"]]
            assert all(any(map(str.isalpha, r[1] or "")) for r in expected)
        elif name == "near_dedup":
            sets, group = near_groups([r[1] for r in rows])
            order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
            kept = {min(g, key=order) for i, g in group.items() if sets[i]} | {i for i in group if not sets[i]}
            left = plain(out)
            assert len(left) == len(kept)
            assert ordered(r[0] for r in left) == ordered(rows[i][0] for i in kept)
            expected = left
            assert not set(map(repr, left)) - set(map(repr, rows))
        elif name == "secrets":
            expected = [(d, redacted(t), lang, s, n if redacted(t) == t else len(redacted(t))) for d, t, lang, s, n in rows]
        elif name == "mixing":
            n = copies([(d, t, s) for d, t, _, s, _ in rows])
            expected = [r for r, c in zip(rows, n, strict=True) for _ in range(c)]
        else:
            break
        assert out.columns == df.columns
        assert ordered(plain(out)) == ordered(expected)
        df = out
    tokenizer = packing.Encoder(packing.vocabulary())
    expected = []
    for d, t, *_ in rows:
        ids = [*tokenizer.whole([t or ""])[0].tolist(), 1]
        for a in range(0, len(ids), packing.LENGTH):
            part = ids[a : a + packing.LENGTH]
            expected.append((d, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)))
    found = out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert ordered(map(tuple, found)) == ordered(expected)


def test_run_equals_its_stages(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES:
        df = stage(spark, df, sf)
    assert ordered(map(tuple, pipeline.run(spark, sf).collect())) == ordered(map(tuple, df.collect()))
