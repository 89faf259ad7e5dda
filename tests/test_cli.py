"""The command line, run in this process."""

import json

import pytest

from refgraph import cli
from refgraph.plans import clean
from refgraph.sources.report import ReportError

from .test_project import tree

FILES = {"src/main.ts": "import { a } from './a'; import './gone'; a();", "src/a.ts": "export const a = 1, spare = 2;", "src/lost.ts": "export const z = 1;", "package.json": "{}"}


@pytest.fixture
def root(spark, tmp_path):
    return tree(tmp_path, FILES)


def run(capsys, *argv):
    code = cli.main(list(argv))
    out = capsys.readouterr()
    return code, out.out, out.err


def test_scan_report_diff_clean(root, tmp_path, capsys):
    code, out, _ = run(capsys, "scan", root)
    saved = tmp_path / ".refgraph" / "latest-report.json"
    assert code == 0 and out.startswith("Scan complete.") and "Orphan files: 1" in out and saved.is_file()
    code, out, _ = run(capsys, "scan", root, "--json", "--output", "old.json")
    found = json.loads(out)
    assert code == 0 and found == json.loads((tmp_path / "old.json").read_text())
    assert [f["file"] for f in found["findings"]["deletionCandidates"]] == [f"{root}/src/lost.ts"]

    assert run(capsys, "report", root, "--format", "md")[1].startswith("# Report")
    assert json.loads(run(capsys, "report", str(saved), "--format", "json")[1])["schemaVersion"] == 2

    code, out, _ = run(capsys, "clean", root)
    assert code == 0 and "src/lost.ts" in out and (tmp_path / "src" / "lost.ts").exists()
    assert run(capsys, "clean", root, "--min-confidence", "0.99", "--apply")[1].startswith("Deleted 0 files")
    assert run(capsys, "clean", root, "--apply")[1] == "Deleted 1 files, left 0 alone.\n" and not (tmp_path / "src" / "lost.ts").exists()

    assert run(capsys, "scan", root)[0] == 0
    counts = json.loads(run(capsys, "diff", str(tmp_path / "old.json"), root, "--format", "json")[1])["summary"]
    assert counts["orphanFiles"] == {"introduced": 0, "resolved": 1, "persisted": 0} and counts["brokenImports"]["persisted"] == 1
    assert run(capsys, "diff", root, root)[1].rstrip().endswith("Totals: introduced 0, resolved 0, persisted 2")
    assert run(capsys, "clean", root)[1] == "No deletion candidates.\n"


def test_errors(root, tmp_path, capsys):
    code, _, err = run(capsys, "report", str(tmp_path / "none.json"))
    assert code == 1 and err.startswith("error:")
    (tmp_path / "bad.json").write_text("{}")
    assert run(capsys, "clean", str(tmp_path / "bad.json"))[0] == 1
    for argv in ([], ["unknown"], ["clean", root, "--min-confidence", "2"], ["report", root, "--format", "pdf"], ["diff", root]):
        with pytest.raises(SystemExit) as e:
            cli.main(argv)
        assert e.value.code == 2


def test_reports_before_version_2(tmp_path, capsys):
    """The command line reads them leniently, the library does not plan from them."""
    path = tmp_path / "old.json"
    path.write_text(json.dumps({"version": 1, "root": str(tmp_path), "findings": {"deletionCandidates": [{"file": "x.ts", "confidence": 0.9}]}}))
    assert "x.ts" in run(capsys, "clean", str(path))[1]
    with pytest.raises(ReportError):
        clean.load(str(path))
