from codeweave.operators import store
from codeweave.plans import index as plan
from codeweave.server import answer

FILES = {
    "pkg/a.py": "from pkg.b import helper\n\ndef main():\n    helper()\n    missing()\n",
    "pkg/b.py": "class Tool:\n    def use(self):\n        return helper()\n\ndef helper():\n    return 1\n",
    "src/J.java": "class J extends Tool { void go() { helper(); } }",
}


def test_index_and_changes(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "index")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = plan.run(spark, str(root), folder)
    assert got["added"] == 3 and got["files"] == 3 and got["symbols"] == 6
    again = plan.run(spark, str(root), folder)
    assert (again["added"], again["changed"], again["deleted"]) == (0, 0, 0)
    views = plan.Views(store.Index(spark, folder))
    edges = {(r.source_id, r.target_id, r.kind): r.resolved for r in views.edges.collect()}
    assert edges["pkg/a.py::main", "pkg/b.py::helper", "calls"] and edges["src/J.java::J.go", "pkg/b.py::helper", "calls"]
    assert edges["pkg/a.py::main", "missing", "calls"] is False
    assert edges["src/J.java::J", "pkg/b.py::Tool", "inherits"]
    assert [(r.path_no, r.position, r.id, r.name) for r in views.trace("main", "helper").collect()] == [(1, 1, "pkg/a.py::main", "main"), (1, 2, "pkg/b.py::helper", "helper")]
    assert {r.id for r in views.related("helper").where("relation = 'caller'").collect()} == {"pkg/a.py::main", "pkg/b.py::Tool.use", "src/J.java::J.go"}
    best = views.hotspots(1).first()
    assert (best["rank"], best.id) == (1, "src/J.java::J")
    # A new symbol catches an old reference; a deleted file's symbols go and edges to them stay unresolved.
    (root / "pkg/c.py").write_text("def missing():\n    pass\n")
    (root / "pkg/b.py").unlink()
    got = plan.run(spark, str(root), folder)
    assert got["added"] == 1 and got["deleted"] == 1
    views = plan.Views(store.Index(spark, folder))
    edges = {(r.source_id, r.target_id, r.kind): r.resolved for r in views.edges.collect()}
    assert edges["pkg/a.py::main", "pkg/c.py::missing", "calls"] and not edges["pkg/a.py::main", "helper", "calls"]
    made = plan.summarize(spark, str(root), folder)
    assert made["asked"] == 3 and made["files"] == 3 and made["directories"] == 2
    again = plan.summarize(spark, str(root), folder)
    assert (again["asked"], again["skipped"], again["errors"]) == (0, 3, 0)
    views = plan.Views(store.Index(spark, folder))
    assert answer(views, str(root), "/api/overview")[1]["files"] == 3
    assert answer(views, str(root), "/api/symbol/pkg/a.py::main")[0] == 200
    shown = answer(views, str(root), "/api/symbol/pkg/a.py::main")[1]
    assert {"id": "pkg/c.py::missing", "name": "missing", "file_path": "pkg/c.py"} in shown["callees"] and shown["callers"] == []
    shown = answer(views, str(root), "/api/file/pkg/a.py")[1]
    assert [x["name"] for x in shown["symbols"]] == ["main"] and shown["language"] == "python" and shown["summary"]
    assert answer(views, str(root), "/api/file/none")[0] == 404
    assert answer(views, str(root), "/api/symbol/none")[0] == 404
    assert answer(views, str(root), "/api/search?q=miss")[1][0]["name"] == "missing"
    assert answer(views, str(root), "/api/search")[0] == 422
    assert answer(views, str(root), "/api/source/../x")[0] == 403
    assert len(answer(views, str(root), "/api/tree")[1]) == 5
    assert answer(views, str(root), "/api/patterns")[0] == 200
    (root / "pkg/a.py").write_text(FILES["pkg/a.py"] + "\nx = 1\n")
    plan.run(spark, str(root), folder)
    stale = {r.target_id: r.is_stale for r in store.Index(spark, folder).table("summaries").collect()}
    assert stale["pkg/a.py"] and stale["pkg"] and not stale["src/J.java"]
