from codeweave.functions.lang import extract, java, python, typescript

PY = '''import a.b as c, d
from .x import y as z

class Base: pass

class Child(Base, metaclass=Meta):
    """doc"""
    @deco(helper())
    def run(self, x: int = f(")"), *args) -> "List[int]":
        def inner(q):
            return go(q)
        self.step(x)
        a(1)
        class Local:
            def deep(self): self.run()
        from m import late
        return [len(v) for v in x]

async def main(): await Child().run(2)

top_level()
'''


def test_python():
    symbols, refs = python.extract(PY)
    by = {s[1]: s for s in symbols}
    assert [s[1] for s in symbols if s[2] == "class"] == ["Base", "Child", "Local"]
    assert by["Child"][3:] == (6, 17, "class Child")
    assert by["Child.run"][2] == "method" and by["Child.run"][5] == 'def run(self, x: int = f(")"), *args) -> "List[int]"'
    assert by["Child.inner"][2] == "method"  # any enclosing class counts
    assert by["Local.deep"][2] == "method"
    assert by["main"][2] == "function" and by["main"][5] == "def main()"
    assert ("Child", "Base", "inherits") in refs and ("Child", "metaclass=Meta", "inherits") in refs
    assert ("__module__", "import a.b as c, d", "imports") in refs
    assert ("Child.run", "from m import late", "imports") in refs
    calls = [(s, t) for s, t, k in refs if k == "calls"]
    assert ("Child.inner", "go") in calls and ("Child.run", "step") in calls and ("Child.run", "len") in calls
    assert ("main", "Child") in calls and ("main", "run") in calls and ("Local.deep", "run") in calls
    assert not any(t in ("a", "top_level", "helper") for _, t in calls)


def test_python_broken():
    symbols, refs = python.extract("import os\nclass A(B):\n    def f(self):\n        call_me(1)\n    def g(:\n")
    assert ("A", "A", "class") in [s[:3] for s in symbols] and ("f", "A.f", "method") in [s[:3] for s in symbols]
    assert ("A.f", "call_me", "calls") in refs and ("__module__", "import os", "imports") in refs


JAVA = """package p;
import java.util.List;
import static a.B.c;
/* class No {} */
@Service("x")
public class Foo<T> extends Base<T> implements Runnable {
  private int n = compute();
  public Foo(int a) { init(a); }
  @Override public List<String> run(int a, Map<K, V> m) throws E {
    String s = "not(a call)"; helper(a); this.other.go(); new Thing(arg()) { void inside() { deepCall(); } };
    return x(1);
  }
  void run() { q.walk(); }
  interface Inner { int size(String s); }
  static class Nested { <R> R gen(R r) { return super.gen(r); } }
}
"""


def test_java():
    symbols, refs = java.extract(JAVA)
    assert [s[1] for s in symbols if s[2] == "class"] == ["Foo", "Nested"]
    methods = [s[1] for s in symbols if s[2] == "method"]
    assert methods.count("Foo.run") == 2 and "Nested.gen" in methods and "Foo.size" in methods and "Foo.inside" in methods
    assert "Foo.Foo" not in methods
    assert next(s for s in symbols if s[1] == "Foo.run")[5] == "List<String> run(int a, Map<K, V> m)"
    assert ("Foo", "Base<T>", "inherits") in refs and not any(t == "Runnable" for _, t, _ in refs)
    assert ("__module__", "import static a.B.c;", "imports") in refs
    calls = {(s, t) for s, t, k in refs if k == "calls"}
    assert {("Foo.run", "helper"), ("Foo.run", "go"), ("Foo.run", "arg"), ("Foo.inside", "deepCall"), ("Foo.run", "walk"), ("Nested.gen", "gen")} <= calls
    assert not any(t in ("init", "compute", "not", "x", "Thing") for _, t in calls)


TS = """import def, { a as b, type C } from './m';
import * as ns from "n";
import './side';
interface Shape extends Base, Other { area(): number }
export class Box<T> extends Parent<T> implements Shape {
  private n = 1;
  constructor(x: number) { super(x); setup(x); }
  async area(k: Map<string, number>): Promise<number> { return this.calc(`v ${inner(k)}`) / 2; }
  handler = () => { fire(); }
}
function plain(x: { a: number }, y = call1()): string { return helper(x); }
const arrow = async (p: string): Promise<void> => { await send(p); };
const short = q => doit(q);
const obj = { method(z) { used(z); }, value: 3 };
list.map((x) => anon(x));
const re = /fake(call)/.test(s);
"""


def test_typescript():
    symbols, refs = typescript.extract(TS)
    by = {s[1]: s for s in symbols}
    assert by["Shape"][5] == "interface Shape" and by["Box"][5] == "class Box"
    assert {("Shape", "Base", "inherits"), ("Shape", "Other", "inherits"), ("Box", "Parent", "inherits"), ("Box", "Shape", "inherits")} <= set(refs)
    assert by["Box.area"][2] == "method" and by["Box.area"][5] == "area(k: Map<string, number>): Promise<number>"
    assert by["Box.constructor"][2] == "method"
    assert by["plain"][5] == "function plain(x: { a: number }, y = call1()): string"
    assert by["arrow"][5] == "const arrow = (p: string): Promise<void> => ..." and by["short"][2] == "function"
    assert by["method"][2] == "function"
    imports = [t for _, t, k in refs if k == "imports"]
    assert imports == ["def|./m", "a|./m", "C|./m", "ns|n"]
    calls = {(s, t) for s, t, k in refs if k == "calls"}
    assert {("Box.area", "calc"), ("Box.area", "inner"), ("plain", "helper"), ("arrow", "send"), ("short", "doit"), ("method", "used"), ("Box.constructor", "setup")} <= calls
    assert not any(t in ("anon", "fake", "fire", "map", "test") for _, t in calls)


def test_never_raises():
    for language in ("python", "java", "typescript", "tsx", "cobol"):
        for text in ("", "}}}}((((", "class", "def f(", "import", "`${", "\0", "<" * 500, "(" * 5000, "class A extends {", '"""'):
            assert isinstance(extract(language, text), tuple)
