import pytest

from lodegraph.sources import extract
from lodegraph.sources.rows import NAMES, valid_aliases

SOURCES = {
    "typescript": (
        """import def, { one as uno, two } from "@app/lib/util";
import * as ns from './x';
// Adds up.
// Two lines.
export function add(a: number, b: number): number { return helper(a) + ns.sum(b); }
export class Box<T> extends Base {
  private n = 1;
  constructor(x: T) { super(x); }
  async get(k: string): Promise<T> { if (k) { return this.store.find(k); } return new Box(k); }
}
interface Shape { area(): number; name: string }
type Id = string | number;
enum Color { Red, Green }
const arrow = async (x: number) => { function inner() { return 1 } return inner(); };
const s = "function no() {}"; /* class No {} */
""",
        {("function", "add"), ("class", "Box"), ("method", "Box.constructor"), ("method", "Box.get"), ("interface", "Shape"), ("method", "Shape.area"), ("type_alias", "Id"), ("enum", "Color"), ("function", "arrow"), ("import", "app.lib.util"), ("import", "..x")},
        {("def", "app.lib.util.default"), ("uno", "app.lib.util.one"), ("two", "app.lib.util.two"), ("ns", "..x")},
        {"helper", "ns.sum", "this.store.find", "inner"},
    ),
    "go": (
        """package main
import f "fmt"
import (
  "os"
  h "net/http"
)
// Server serves.
type Server struct { n int }
type Doer interface { Do() error }
func (s *Server) Start(p int) error { return h.Listen(p) }
func main() { run(func() { f.Println("x(") }) }
""",
        {("struct", "Server"), ("interface", "Doer"), ("method", "Server.Start"), ("function", "main"), ("import", "fmt"), ("import", "os"), ("import", "net.http")},
        {("f", "fmt"), ("h", "net.http")},
        {"h.Listen", "run", "f.Println"},
    ),
    "rust": (
        """use std::collections::HashMap as Map;
use crate::{a::{b as c, d}, e};
/// A point.
pub struct Point { x: i32 }
enum Kind { A, B }
trait Walk { fn step(&self); }
impl<T> Walk for Point { fn step(&self) { go(self.x); } }
mod inner { fn hidden() {} }
pub async fn run<'a>(p: &'a Point) -> i32 { Point::new(p).step() }
""",
        {("struct", "Point"), ("enum", "Kind"), ("trait", "Walk"), ("method", "Point::step"), ("function", "run"), ("import", "std::collections::HashMap"), ("import", "crate::a::b"), ("import", "crate::a::d"), ("import", "crate::e")},
        {("Map", "std::collections::HashMap"), ("c", "crate::a::b")},
        {"go", "Point::new"},
    ),
    "java": (
        """package p;
import java.util.List;
import java.io.*;
/** Does things. */
public class A<T> implements I {
  public A(int n) { init(n); }
  @Override
  public List<String> names(Map<String, T> m) throws IOException { return this.repo.all(m); }
  static class Inner { void deep() { call(); } }
  enum E { X { void no() {} } }
}
interface I { int size(); }
record R(int a) {}
""",
        {("class", "A"), ("constructor", "A.A"), ("method", "A.names"), ("class", "A.Inner"), ("method", "A.Inner.deep"), ("enum", "A.E"), ("interface", "I"), ("method", "I.size"), ("record", "R"), ("import", "java.util.List"), ("import", "java.io")},
        {("List", "java.util.List")},
        {"init", "this.repo.all", "call"},
    ),
    "cpp": (
        """#include <vector>
#include "a/b.h"
typedef unsigned long size;
namespace app {
// Holds.
class Box {
 public:
  explicit Box(int n) : n_(n) { setup(); }
  int get() const { return n_; }
  int get() { return n_; }
};
struct Pair { int a; };
template <typename T>
T most(T a, T b) { return std::max(a, b); }
}
int app::Box::later(int x) { return this->get(x); }
static void plain(void) { obj.run(); }
""",
        {("class", "app::Box"), ("method", "app::Box::Box"), ("method", "app::Box::get"), ("struct", "app::Pair"), ("function", "app::most"), ("method", "app::Box::later"), ("function", "plain"), ("typedef", "size"), ("import", "vector"), ("import", "a/b.h")},
        set(),
        {"setup", "std::max", "this.get", "obj.run"},
    ),
    "csharp": (
        """using System;
using Col = System.Collections;
namespace App.Core {
  /// <summary>Works.</summary>
  public class Job : Base {
    public Job(int n) : base(n) { Init(n); }
    public async Task<int> Run(string x) { return await client.Get(x); }
    public int Twice(int x) => Math.Abs(x);
  }
  interface IJob { void Stop(); }
  struct P { }
  enum E { A }
}
""",
        {("class", "App.Core.Job"), ("constructor", "App.Core.Job.Job"), ("method", "App.Core.Job.Run"), ("method", "App.Core.Job.Twice"), ("interface", "App.Core.IJob"), ("method", "App.Core.IJob.Stop"), ("struct", "App.Core.P"), ("enum", "App.Core.E"), ("import", "System"), ("import", "System.Collections")},
        {("Col", "System.Collections")},
        {"Init", "client.Get", "Math.Abs"},
    ),
    "c": (
        """#include <stdio.h>
struct node { int v; struct node *next; };
/* Adds. */
int add(int a, int b) { printf("%d {", a); return a + b; }
int declared(int a);
""",
        {("struct", "node"), ("function", "add"), ("import", "stdio.h")},
        set(),
        {"printf"},
    ),
}


def rows_of(language, text):
    return [dict(zip(NAMES, r)) for r in extract.extract_one("f", language, text)]


@pytest.mark.parametrize("language", SOURCES)
def test_units_aliases_and_calls(language):
    text, units, aliases, calls = SOURCES[language]
    rows = rows_of(language, text)
    assert {(r["unit_type"], r["qualname"]) for r in rows if r["rec"] == "unit"} == units
    assert {(r["name"], r["target"]) for r in rows if r["rec"] == "alias"} == aliases
    assert calls <= {r["qualname"] for r in rows if r["rec"] == "call"}
    for r in rows:
        if r["rec"] == "unit" and r["unit_type"] != "import":
            part = extract.slice_bytes(text, r["byte_start"], r["byte_end"])
            assert r["name"] in part and text.encode()[: r["byte_start"]].count(b"\n") == r["start_line"] - 1
    if language == "cpp":
        assert sum(r["qualname"] == "app::Box::get" for r in rows) == 2


def test_comments_above_become_summaries():
    by = {r["qualname"]: r["summary"] for r in rows_of("typescript", SOURCES["typescript"][0])}
    assert by["add"] == "Adds up. Two lines." and by["Box"] == ""
    assert {r["qualname"]: r["summary"] for r in rows_of("java", SOURCES["java"][0])}["A"] == "Does things."


def test_broken_sources_do_not_fail():
    for language in SOURCES:
        text = SOURCES[language][0]
        for cut in range(0, len(text), 17):
            rows_of(language, text[:cut])
            rows_of(language, "é" + text[cut:] + "}")
    assert rows_of("unknown", "x") == [] and list(valid_aliases([("a", "x"), ("a", "y"), ("1", "z"), ("b", "")])) == [("a", "x")]


def test_registered_extractors_reach_the_workers(spark):
    from lodegraph.sources.rows import row

    extract.register("made", lambda path, text, language: iter([row(path, "unit", "symbol", "function", text, text)]))
    try:
        files = spark.createDataFrame([("a", "made", "x"), ("b", "go", "func y() {}"), ("c", "none", "z")], "path string, language string, text string")
        assert {(r.path, r.name) for r in extract.extract(files).collect()} == {("a", "x"), ("b", "y")}
    finally:
        del extract.EXTRACTORS["made"]
