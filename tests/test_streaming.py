from refgraph.plans import project
from refgraph.sources.config import ProjectConfig
from refgraph.streaming.rescan import Rescan, follow


def test_stream_ends_where_a_scan_does(spark, tmp_path):
    rows = [("/p/a.ts", "import {b} from './b'; b()"), ("/p/b.ts", "export const b = 1, c = 2"), ("/p/c.ts", "import './none'")]
    for n, batch in enumerate(([rows[0], ("/p/b.ts", "export const old = 1")], rows[1:])):
        spark.createDataFrame(batch, "file string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rescan = Rescan(spark, str(tmp_path / "out"))  # a new one, as after a restart
        assert rescan.parsed().count() == 2 * n
        stream = spark.readStream.schema("file string, content string").parquet(str(tmp_path / "in"))
        follow(stream, rescan, str(tmp_path / "log")).awaitTermination()
    found = rescan.scan(ProjectConfig("/p"))
    whole = project.analyze(project.parse_sources(spark.createDataFrame(rows, "file string, content string")), spark.createDataFrame([(f,) for f, _ in rows], "path string"), ProjectConfig("/p"))
    for name in project.FINDINGS:
        assert sorted(map(tuple, found.findings[name].collect())) == sorted(map(tuple, whole.findings[name].collect())), name
    assert [r.exportName for r in found.findings["deadExports"].collect()] == ["c"]
