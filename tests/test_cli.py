from __future__ import annotations

import os
import stat

import pytest

from folio import sample
from folio.__main__ import main, prepare_output


@pytest.fixture
def project(spark, tmp_path):
    return sample.materialize(str(tmp_path))


def run(capsys, *args: str) -> tuple[int, str, str]:
    code = main([*args, "-j", "2"])
    got = capsys.readouterr()
    return code, got.out, got.err


def test_the_dump_is_never_its_own_input(capsys, project):
    out = os.path.join(project, "dump.txt")
    for _ in range(2):
        assert run(capsys, project, "-o", out)[0] == 0
        with open(out) as f:
            text = f.read()
        assert "dump.txt" not in text and "FILE: src/main.py" in text
    os.chmod(out, 0o640)
    run(capsys, project, "-o", out, "--format", "xml")
    assert stat.S_IMODE(os.stat(out).st_mode) == 0o640
    with open(out) as f:
        assert f.read().startswith("<documents>")


def test_destinations_are_checked_first(capsys, project, tmp_path):
    code, _, err = run(capsys, os.path.join(project, "readme.md"), "-o", os.path.join(project, "readme.md"))
    assert code == 1 and "destroy the input" in err
    assert "is a directory" in run(capsys, project, "-o", project)[2]
    assert "does not exist" in run(capsys, project, "-o", str(tmp_path / "no" / "x"))[2]
    assert "does not exist" in run(capsys, str(tmp_path / "missing"))[2]
    os.mkfifo(tmp_path / "p")
    assert prepare_output(str(tmp_path / "p"), []).place == str(tmp_path / "p")
    assert prepare_output("/dev/null", []).place == "/dev/null"


def test_summary_list_tokens_and_map(capsys, project):
    code, text, err = run(capsys, project, "--max-entries", "1")
    assert code == 0 and "truncated" in err and text.count("FILE: ") == 1
    _, text, err = run(capsys, project)
    assert "truncated" not in err and "Counts trees" in text and "├── " in text and "icon.bin" not in text and "two rows" not in text.lower().replace("two rows of quince", "")
    _, text, err = run(capsys, project, "--list")
    assert "data/harvest.csv" in text.split("\n") and "icon.bin" not in text and "listed 11 files" in err
    assert run(capsys, project, "--tokens")[1].startswith("~")
    _, text, _ = run(capsys, project, "--tree-only", "--format", "md")
    assert text.startswith("# Directory structure") and "FILE" not in text
    _, text, _ = run(capsys, project, "--archives", "-q")
    assert "Late frost in May." in text


def test_a_root_archive_and_warnings(capsys, project):
    assert "Late frost" in run(capsys, os.path.join(project, "data", "older.zip"))[1]
    os.symlink("nowhere", os.path.join(project, "src", "broken"))
    _, _, err = run(capsys, project, "--follow-links")
    assert "warning: " in err and "src/broken" in err
