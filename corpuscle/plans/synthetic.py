"""Source corpora made of a table's rows: as many files as rows, names and sizes by their IDs.

Each template holds what misleads a reader of lines: a glob with a comment's
opening inside a string, one-line docstrings, nested types, calls in bodies.
{d} stands for the row's ID; lines of a part are repeated as its ID says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(template: str) -> Column:
    """The template with the row's ID d in place of {d}."""
    return F.replace(F.lit(template), F.lit("{d}"), F.col("d").cast("string"))


def repeated(template: str, times: Column) -> Column:
    """The filled template `times` times, with 1, 2, ... in place of {k}."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), lambda k: F.replace(filled(template), F.lit("{k}"), k.cast("string")))
    return F.when(times > 0, F.array_join(each, "")).otherwise("")


APP = """from pkg{d}.store import Store{d}

def main{d}():
    s = Store{d}()
    load{d}(s)
    save{d}(s)

def load{d}(s):
    parse{d}(s)
    save{d}(s)
    print(len(s))

def save{d}(s):
    flush{d}(s)

def parse{d}(s):
    parse{d}(s)
"""
EXTRA = """
def extra{d}_{k}():
    save{d}(None)
"""
STORE = '''class Store{d}:
    """One line."""
    def get(self): """Another."""
'''
TEST = """from pkg{d}.app import load{d}
def test_load{d}():
    load{d}(None)
"""


def ids(table: DataFrame, id_col: str) -> DataFrame:
    return table.select(F.col(id_col).alias("d"))


def python_files(d: DataFrame) -> DataFrame:
    """(path, content) of a package for each ID: a store, an application with d % 3 extra functions, and its test."""
    parts = {"store.py": filled(STORE), "app.py": F.concat(filled(APP), repeated(EXTRA, (F.col("d") % 3).cast("int"))), "tests/test_app.py": filled(TEST)}
    row = F.array(*[F.struct(F.concat(F.lit("pkg"), F.col("d").cast("string"), F.lit(f"/{name}")).alias("path"), content.alias("content")) for name, content in parts.items()])
    return d.select(F.explode(row).alias("f")).select("f.*")


#: By language: a file's name, and its template. {m} stands for d % 3 repetitions of the line after it.
LANGUAGES: dict[str, tuple[str, str]] = {
    "javascript": ("web/a{d}.ts", """const files{d} = "src/**/*.ts";
/* one line */
export interface Shape{d} {
  area(): number;
}
export class Box{d} implements Shape{d} {
  area() {
    return helper{d}(2);
  }
}
export const helper{d} = (x) => x;
/*
class Hidden{d} {
}
*/
export function last{d}() {
}
"""),
    "java": ("src/Box{d}.java", """package p;
public class Box{d} {
  private String glob = "a/**/*.java";
  @Override
  public int area() {
    return helper{d}(1);
  }
  static class Inner{d} {
    void run() {
    }
  }
  private static int helper{d}(int x) {
    return x;
  }
}
"""),
    "csharp": ("Lib/Box{d}.cs", """using System;
namespace Lib.Parts;
public class Box{d} : IShape
{
    private readonly Dictionary<string, List<int>> _sizes = new();
    public event EventHandler Changed{d};
    public string Name { get; set; } = "/**/*.cs";
    public Box{d}(IShape other)
    {
        var x = Helper(1);
    }
    public class Inner{d}
    {
        public int Depth => 2;
    }
    private static int Helper(int a) => a;
}
"""),
    "go": ("cmd/a{d}.go", """package main
const glob{d} = "a/**/*.go"
type Box{d} struct {
}
func (b *Box{d}) Area() int {
	return 1
}
func Run{d}() {
}
"""),
    "rust": ("src/a{d}.rs", """pub struct Box{d} {
}
impl Box{d} {
    pub fn area(&self) -> i32 {
        1
    }
}
const GLOB{d}: &str = "a/**/*.rs";
fn run{d}() {
}
"""),
    "cpp": ("lib/a{d}.cpp", """#include <string>
namespace lib{d} {
class Box{d} {
};
int area(int x) {
  return x;
}
}
"""),
    "python": ("py/a{d}.py", '''X{d} = """one line"""
def quick{d}(): """doc"""
def long{d}():
    """
    def hidden(): pass
    """
    return 1
class Box{d}:
    def area(self):
        def inner():
            pass
'''),
}

#: What each template declares: (name, kind, containing, start line, end line).
DECLARED: dict[str, list[tuple[str, str, str, int, int]]] = {
    "javascript": [("Shape{d}", "interface", "(global)", 3, 5), ("area", "method", "Shape{d}", 4, 4), ("Box{d}", "class", "(global)", 6, 10), ("area", "method", "Box{d}", 7, 9), ("helper{d}", "function", "(global)", 11, 11), ("last{d}", "function", "(global)", 16, 17)],
    "java": [("Box{d}", "class", "(global)", 2, 15), ("area", "method", "Box{d}", 5, 7), ("Inner{d}", "class", "Box{d}", 8, 11), ("run", "method", "Inner{d}", 9, 10), ("helper{d}", "method", "Box{d}", 12, 14)],
    "csharp": [
        ("Lib.Parts", "namespace", "(global)", 2, 2), ("Box{d}", "class", "(global)", 3, 17), ("_sizes", "field", "Box{d}", 5, 5), ("Changed{d}", "event", "Box{d}", 6, 6), ("Name", "property", "Box{d}", 7, 7),
        ("Box{d}", "constructor", "Box{d}", 8, 11), ("Inner{d}", "class", "Box{d}", 12, 15), ("Depth", "property", "Inner{d}", 14, 14), ("Helper", "method", "Box{d}", 16, 16),
    ],
    "go": [("glob{d}", "variable", "(global)", 2, 2), ("Box{d}", "type", "(global)", 3, 4), ("Area", "function", "(global)", 5, 7), ("Run{d}", "function", "(global)", 8, 9)],
    "rust": [("Box{d}", "struct", "(global)", 1, 2), ("area", "method", "Box{d}", 4, 6), ("GLOB{d}", "const", "(global)", 8, 8), ("run{d}", "function", "(global)", 9, 10)],
    "cpp": [("lib{d}", "namespace", "(global)", 2, 8), ("Box{d}", "class", "lib{d}", 3, 4), ("area", "function", "lib{d}", 5, 7)],
    "python": [("X{d}", "variable", "(global)", 1, 1), ("quick{d}", "function", "(global)", 2, 2), ("long{d}", "function", "(global)", 3, 7), ("Box{d}", "class", "(global)", 8, 11), ("area", "function", "Box{d}", 9, 11), ("inner", "function", "area", 10, 11)],
}


def language_files(d: DataFrame, language: str) -> DataFrame:
    name, template = LANGUAGES[language]
    return d.select(filled(name).alias("path"), filled(template).alias("content"))


#: By language group: a source file, and configuration files in order of precedence, each with how it sets KEY.
CONFIGS: dict[str, tuple[str, list[tuple[str, int, str, str, int]]]] = {
    "csharp": ("a.cs", [("appsettings.Local.json", 1, '{\n"App": {"Key": {v}.0}}', "App:Key", 2), ("appsettings.Development.json", 3, '{"App": {"Key": {v}}}', "App:Key", 1), ("appsettings.json", 4, '{"App": {"Key": {v}}}', "App:Key", 1), ("Properties/launchSettings.json", 5, '{"key": {v}}', "key", 1)]),
    "jsts": ("a.ts", [(".env.test.local", 1, "KEY={v}", "KEY", 1), (".env.local", 2, 'KEY="{v}"', "KEY", 1), (".env.production", 3, "# KEY=0\nKEY={v}", "KEY", 2), (".env", 4, "KEY='{v}'", "KEY", 1)]),
    "python": ("a.py", [("settings.py", 2, "KEY = '{v}'", "KEY", 1), ("config.yaml", 2, "app:\n  key: {v} # c", "app.key", 2), (".env", 3, "KEY={v}", "KEY", 1), ("pyproject.toml", 4, "[app]\nkey = \"{v}\"", "app.key", 2)]),
    "java": ("A.java", [("src/main/resources/application-dev.properties", 2, "key={v}", "key", 1), ("application.yml", 3, "app:\n  key: '{v}'", "app.key", 2), ("bootstrap.properties", 4, "! no\nkey: {v}", "key", 2)]),
    "go": ("a.go", [("config.json", 2, '{"key": "{v}"}', "key", 1), ("configs/x.toml", 2, "key = {v}", "key", 1), (".env", 3, "KEY={v}", "KEY", 1)]),
    "rust": ("a.rs", [("config/local.toml", 1, "key = {v}", "key", 1), ("config/prod.toml", 2, "[a]\nkey = {v}", "a.key", 2), ("config/default.toml", 3, "key = {v}", "key", 1)]),
    "c_cpp": ("a.cpp", [("my_config.h", 2, "#define KEY {v} // c", "KEY", 1), ("CMakeLists.txt", 3, "set(KEY {v})", "KEY", 1), ("config/a.ini", 3, "[a]\nkey = {v}", "a:key", 2)]),
}


def config_corpus(counted: DataFrame, language: str) -> DataFrame:
    """(path, content): a source file and configuration files whose values are counted's number n and the file's place."""
    source, files = CONFIGS[language]
    rows = [F.struct(F.lit(source).alias("path"), F.lit("").alias("content"))]
    # a folder below, and a name that only looks like one: neither is discovered
    rows += [F.struct(F.lit(f"deep/er/{files[0][0]}").alias("path"), F.lit(files[0][2]).alias("content"))]
    for k, (path, _, text, _, _) in enumerate(files):
        rows.append(F.struct(F.lit(path).alias("path"), F.replace(F.lit(text), F.lit("{v}"), (F.col("n") + k).cast("string")).alias("content")))
    return counted.select(F.explode(F.array(*rows)).alias("f")).select("f.*")
