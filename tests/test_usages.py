from riskloom.operators import usages as U
from riskloom.sources.code import CODE, facts_of

MAIN = """import yaml as y
from helpers import clean
from os import path

@clean
def run(x: path) -> None:
    y.load(clean(x))

def other():
    run(1)

other()
"""
HELPERS = """import pickle
__all__ = ["clean"]

def clean(x):
    return pickle.loads(x)

def hidden():
    pass
"""
WEB = """import _, { template as t } from 'lodash';
import * as ns from "left-pad";
const { merge } = require('deep');
export function page(x) {
  return t(x) + _.map(x, ns.pad);
}
export const LIMIT = 3;
module.exports = { page, merge: merge };
"""
GO = """package main

import (
\t"fmt"
\tyaml "gopkg.in/yaml.v3"
)

func Run(a int) {
\tyaml.Unmarshal(nil, nil)
}

func (s *Server) helper() { fmt.Println("x") }
"""
RUBY = """require 'json'
require_relative 'lib/my_tool'

class Job
  def call(x)
    JSON.parse(x)
    MyTool.run(x)
  end
end
"""
FILES = {"app/main.py": MAIN, "app/helpers.py": HELPERS, "web/page.ts": WEB, "main.go": GO, "job.rb": RUBY}


def facts(spark, files=FILES):
    rows = [("r", path, *f, i) for path, text in files.items() for i, f in enumerate(facts_of(path, text))]
    return spark.createDataFrame(rows, CODE)


def test_uses(spark):
    got = {(r["path"], r["name"], r["target"], r["how"], r["line"]) for r in U.usages(facts(spark)).collect()}
    assert {x[1:] for x in got if x[0] == "app/main.py"} == {("y", "yaml", "call", 7), ("clean", "helpers.clean", "call", 7), ("clean", "helpers.clean", "decorator", 5), ("path", "os.path", "annotation", 6)}
    assert {x[1:4] for x in got if x[0] == "web/page.ts"} == {("t", "lodash.template", "call"), ("_", "lodash", "call"), ("ns", "left-pad", "attribute"), ("merge", "deep.merge", "name")}
    assert {x[1:4] for x in got if x[0] == "main.go"} == {("yaml", "gopkg.in/yaml.v3", "call"), ("fmt", "fmt", "call")}
    assert {x[1:4] for x in got if x[0] == "job.rb"} == {("JSON", "json", "call"), ("MyTool", "lib/my_tool", "call")}


def test_exports(spark):
    got = {(r["path"], r["name"], r["detail"]) for r in facts(spark).filter("kind = 'export'").collect()}
    assert {x[1:] for x in got if x[0] == "app/helpers.py"} == {("clean", "function")}
    assert {x[1:] for x in got if x[0] == "app/main.py"} == {("run", "function"), ("other", "function")}
    assert {x[1:] for x in got if x[0] == "web/page.ts"} >= {("page", "function"), ("LIMIT", "variable"), ("merge", "name")}
    assert {x[1:] for x in got if x[0] == "main.go"} == {("Run", "function")}


def test_calls_reach_sinks(spark):
    edges = U.call_edges(facts(spark))
    got = {(r["caller"], r["callee"]) for r in edges.collect()}
    assert {("app/main.py:run", "yaml.load"), ("app/main.py:run", "app/helpers.py:clean"), ("app/helpers.py:clean", "pickle.loads"), ("app/main.py:other", "app/main.py:run"), ("app/main.py:<module>", "app/main.py:other")} <= got
    sinks = spark.createDataFrame([("pickle.loads",), (None,)], "name string")
    assert {(r["node"], r["depth"], r["via"]) for r in U.reached(edges, sinks).collect()} == {
        ("pickle.loads", 0, None), ("app/helpers.py:clean", 1, "pickle.loads"), ("app/main.py:run", 2, "app/helpers.py:clean"), ("app/main.py:other", 3, "app/main.py:run"), ("app/main.py:<module>", 4, "app/main.py:other"),
    }
    assert U.reached(edges, sinks.limit(0)).count() == 0 and U.reached(edges.limit(0), sinks).count() == 0


def test_unreadable(spark):
    assert facts_of("x.py", "def (") == [] and facts_of("x.txt", "import a") == [] and facts_of("x.go", "") == []
    assert U.usages(facts(spark).limit(0)).count() == 0
