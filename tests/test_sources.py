import pytest

from codeweave.sources import files


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "pkg/a.py": "def f(): pass\n", "pkg/UPPER.PY": "x = 1\n", "build/x.py": "", "notes.md": "", "out/gen.ts": "", "keep/out.ts": "", "pkg/bad.py": "def (",
        "src/J.java": "class J {}", ".gitignore": "# comment\nout/\n*.tsx\n!ok.tsx\n/root_only.py\n", "a.tsx": "", "ok.tsx": "", "root_only.py": "", "sub/root_only.py": "",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_discover(spark, tree):
    got = {(r.path, r.language) for r in files.discover(spark, str(tree)).select("path", "language").collect()}
    assert got == {("pkg/a.py", "python"), ("pkg/UPPER.PY", "python"), ("keep/out.ts", "typescript"), ("pkg/bad.py", "python"), ("src/J.java", "java"), ("ok.tsx", "tsx"), ("sub/root_only.py", "python")}


def test_guard(tree):
    assert files.source_text(str(tree), "pkg/a.py") == "def f(): pass\n"
    with pytest.raises(PermissionError):
        files.source_text(str(tree), "../../etc/passwd")


def test_no_repository(tmp_path):
    assert files.head(str(tmp_path)) is None
