import json

from riskloom.sources.code import facts, facts_of
from riskloom.sources.manifests import detect, parse_manifest, read_files, scan


def rows(path, text):
    _, got, error = parse_manifest(path, text)
    assert error is None, error
    return got


def test_package_lock():
    v2 = {"lockfileVersion": 3, "packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1.0"}, "node_modules/x/node_modules/@s/b": {"version": "2.0", "dev": True}, "node_modules/none": {}}}
    assert rows("package-lock.json", json.dumps(v2)) == [("a", "1.0", False, True, None), ("@s/b", "2.0", True, False, None)]
    v1 = {"dependencies": {"a": {"version": "1.0", "dependencies": {"b": {"version": "2.0"}}}}}
    assert rows("d/package-lock.json", json.dumps(v1)) == [("a", "1.0", False, True, None), ("b", "2.0", False, False, "a")]


def test_yarn_and_pnpm():
    classic = '# yarn lockfile v1\n\n"@s/a@^1.0", "@s/a@^1.1":\n  version "1.2.3"\n  resolved "x"\n\nb@2:\n  version "2.0.0"\n'
    assert [(n, v) for n, v, *_ in rows("yarn.lock", classic)] == [("@s/a", "1.2.3"), ("b", "2.0.0")]
    berry = '__metadata:\n  version: 6\n\n"c@npm:^3.0":\n  version: 3.1.0\n'
    assert [(n, v) for n, v, *_ in rows("yarn.lock", berry)] == [("c", "3.1.0")]
    pnpm = "lockfileVersion: '6.0'\n\npackages:\n\n  /@s/a@1.0.0(react@18.0.0):\n    dev: false\n\n  /b@2.0.0:\n    dev: true\n"
    assert [(n, v) for n, v, *_ in rows("pnpm-lock.yaml", pnpm)] == [("@s/a", "1.0.0"), ("b", "2.0.0")]


def test_python_files():
    text = "# c\nDjango[argon2]>=3.2,<4 ; python_version > '3'\nflask==2.0  # web\nbare\n-r other.txt\n-e git+https://x/y#egg=own\n"
    assert [(n, v) for n, v, *_ in rows("requirements.txt", text)] == [("django", "3.2"), ("flask", "2.0"), ("bare", "unknown"), ("own", "editable")]
    assert rows("requirements-dev.txt", "x==1")[0][2] is True
    assert rows("Pipfile.lock", json.dumps({"default": {"a": {"version": "==1"}}, "develop": {"b": {"version": "==2"}}})) == [("a", "1", False, True, None), ("b", "2", True, True, None)]
    assert rows("poetry.lock", '[[package]]\nname = "a"\nversion = "1"\ncategory = "dev"\n')[0][:3] == ("a", "1", True)


def test_go_rust_ruby_maven_composer():
    mod = "module m\n\nrequire (\n\tx.io/a v1.0.0\n\tx.io/b v2.0.0+incompatible // indirect\n)\nrequire x.io/c v3.0.0\nreplace x.io/c => y.io/c v3.1.0\n"
    assert [(n, v, d) for n, v, _, d, _ in rows("go.mod", mod)] == [("x.io/a", "1.0.0", True), ("x.io/b", "2.0.0", False), ("y.io/c", "3.1.0", True)]
    assert len(rows("go.sum", "x.io/a v1.0.0 h1:x\nx.io/a v1.0.0/go.mod h1:y\n")) == 1
    assert [r[0] for r in rows("Cargo.lock", '[[package]]\nname = "root"\nversion = "1"\n\n[[package]]\nname = "dep"\nversion = "2"\nsource = "r"\n')] == ["dep"]
    gem = "GEM\n  remote: r\n  specs:\n    rails (7.0.1)\n      rack (>= 2)\n    rack (2.2)\n\nDEPENDENCIES\n  rails\n"
    assert {(n, v, d) for n, v, _, d, _ in rows("Gemfile.lock", gem)} == {("rails", "7.0.1", True), ("rack", "2.2", False)}
    pom = '<project xmlns="http://m"><properties><v>1.5</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>'
    assert rows("pom.xml", pom) == [("g:a", "1.5", False, True, None), ("g:t", "managed", True, True, None)]
    assert rows("composer.lock", json.dumps({"packages": [{"name": "a/b", "version": "v1.2"}], "packages-dev": [{"name": "c/d", "version": "vx"}, {}]})) == [("a/b", "1.2", False, False, None), ("c/d", "vx", True, False, None)]


def test_scan_keeps_errors_and_detects(spark, tmp_path):
    files = spark.createDataFrame([("r", "package-lock.json", "{", 1), ("r", "sub/go.mod", "require x v1.0.0", 1), ("r", "README", "x", 1), ("r", None, None, 1), ("r", "requirements.txt", None, 1)], "repo_id string, path string, text string, ord int")
    got = scan(files).collect()
    assert len(got) == 2 and {r["ecosystem"] for r in got} == {"npm", "go"} and [r["error"] for r in got if r["ecosystem"] == "npm"][0]
    assert {r["ecosystem"] for r in detect(files.filter("path is not null")).collect()} == {"npm", "pypi"}
    assert scan(files.limit(0)).count() == 0
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "requirements.txt").write_text("a==1\n")
    (tmp_path / "node_modules" / "requirements.txt").write_text("b==1\n")
    assert [(r["path"], r["text"]) for r in read_files(spark, str(tmp_path), "requirements*.txt").collect()] == [("requirements.txt", "a==1\n")]


PY = "import os.path as p\nfrom .m import f as g, h\n\nclass A:\n    def run(self, x):\n        return g(p.join(x))\n\ndef top(a, *, b):\n    A().run(a)\n    os.system(b)\n"
JS = "import { a as b } from 'pkg';\nconst q = require(\"other\");\n// call(x)\nexport async function go(x) {\n  b(x); q.send('call(y)');\n}\nconst arrow = (z) => b(z);\n"


def test_code(spark):
    py = {(k, n, d) for k, n, d, *_ in facts_of("a.py", PY)}
    assert {("import", "os.path", "p"), ("import", ".m.f", "g"), ("import", ".m.h", "h"), ("def", "A.run", "self,x"), ("def", "top", "a,b"), ("call", "g", None), ("call", "p.join", None), ("call", "os.system", None)} <= py
    js = {(k, n) for k, n, *_ in facts_of("a.ts", JS)}
    assert {("import", "pkg"), ("import", "other"), ("def", "go"), ("def", "arrow"), ("call", "b"), ("call", "q.send")} <= js and ("call", "call") not in js and ("call", "go") not in js
    assert facts_of("a.py", "def (") == [] and facts_of("a.rb", "x") == []
    files = spark.createDataFrame([("r", "a.py", PY), ("r", None, None), ("r", "b.js", "")], "repo_id string, path string, text string")
    assert facts(files).filter("kind = 'import'").count() == 3
