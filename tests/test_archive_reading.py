"""Archives are opened once, and short ones share the batches that are sent on."""

from __future__ import annotations

import io
import zipfile

from obsframe.sources import archives


def zipped(code, lines):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(archives.RAINFALL.member_of(code), "".join(f"{line}\r\n" for line in [",".join(archives.heading(archives.RAINFALL)), *lines]))
    return bytearray(out.getvalue())


def test_the_lines_of_short_archives_go_on_together(spark, monkeypatch):
    rows = [(str(i), zipped(str(i), [f"IDCJAC0009,{i},2000,01,0{d},1.5,1,Y" for d in range(1, 1 + i % 4)])) for i in range(50)]
    content = spark.createDataFrame([*rows, ("x", bytearray(b"no zip"))], "station string, content binary").coalesce(1)
    kept = []

    class Taken:
        columns = ("station", "content")

        def select(self, *columns):
            return self

        def mapInArrow(self, reader, schema):
            kept.extend(reader(iter(content.toArrow().combine_chunks().to_batches())))

    archives.archive_lines(Taken(), archives.RAINFALL)
    assert len(kept) == 1 and kept[0].num_rows == 50 + sum(i % 4 for i in range(50)) + 1
    loaded = archives.load_archives(content, archives.RAINFALL, "s").groupBy("station").count().collect()
    assert {r["station"]: r["count"] for r in loaded} == {str(i): i % 4 for i in range(50) if i % 4}


def test_validation_reads_the_archives_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    line = "IDCJAC0009,1,2000,01,01,1.5,1,Y"
    rows = [("1", zipped("1", [line, "   ", line])), ("2", zipped("2", [])), ("3", bytearray(b"no zip")), ("1", zipped("1", [line]))]
    content = spark.createDataFrame(rows, "station string, content binary")
    listed = spark.createDataFrame([(c,) for c in "1234"], "station string")
    out = archives.validate_archives(listed, content.mapInArrow(counted, content.schema), archives.RAINFALL).collect()
    got = {r["station"]: (r["status"], r["error"], r["rows"]) for r in out}
    assert got == {"1": ("Good", "", 3), "2": ("No Data", "", 0), "3": ("Read Error", "BadZipFile", 0), "4": ("Data Missing", "", 0)}
    assert seen.value == 4
