from lodestone.sources import settings

YAML = """# a workflow
name: "CI: all"   # named
on:
  pull_request:
    branches: [main, 'rel/*']
permissions: {}
jobs:
  build:
    runs-on: ubuntu-latest
    steps:
    - uses: actions/checkout@v4   # same column as its key
      with:
        ref: ${{ github.head_ref }}
    - run: |
        echo "a: b"
        # kept

        - not an item
    - name: 'x # y'
  "quoted job":
    needs:
      - build
      - - a
        - b: 1
text: one
  two
---
next: http://x:80/y
- https://z
"""

TOML = """[package]
name = "a" # it
version.workspace = true

[dependencies]
x = { path = "../x", features = ["a", "b"], version = "1" }
"y-z" = "2" # = no
list = [
  "one", # first
  'two',
]
after = [1, 2]
[[bin]]
name = 'b]'
[target.'cfg(unix)'.dependencies]
u = "3"
"""


def facts(df):
    return [(r.line, "/".join(r["keys"]), r.value) for r in df.orderBy("path", "line", "keys").collect()]


def test_yaml(spark):
    f = spark.createDataFrame([("r", "a", YAML), ("r", "b", None), ("r", "c", ""), ("q", "d", "\r\n# x\r\na:\r\n  b: 'c'\r\n")], "repo string, path string, text string")
    assert facts(settings.yaml_facts(f)) == [
        (2, "name", "CI: all"), (3, "on", None), (4, "on/pull_request", None), (5, "on/pull_request/branches", None), (5, "on/pull_request/branches/#5.0", "main"), (5, "on/pull_request/branches/#5.1", "rel/*"),
        (6, "permissions", "{}"), (7, "jobs", None), (8, "jobs/build", None), (9, "jobs/build/runs-on", "ubuntu-latest"), (10, "jobs/build/steps", None), (11, "jobs/build/steps/#11/uses", "actions/checkout@v4"),
        (12, "jobs/build/steps/#11/with", None), (13, "jobs/build/steps/#11/with/ref", "${{ github.head_ref }}"), (14, "jobs/build/steps/#14/run", None), (15, "jobs/build/steps/#14/run", 'echo "a: b"'),
        (16, "jobs/build/steps/#14/run", "# kept"), (18, "jobs/build/steps/#14/run", "- not an item"), (19, "jobs/build/steps/#19/name", "x # y"), (20, "jobs/quoted job", None), (21, "jobs/quoted job/needs", None),
        (22, "jobs/quoted job/needs/#22", "build"), (23, "jobs/quoted job/needs/#23/#23-1", "a"), (24, "jobs/quoted job/needs/#23/#24/b", "1"), (25, "text", "one"), (26, "text", "two"), (28, "next", "http://x:80/y"),
        (29, "next/#29", "https://z"), (3, "a", None), (4, "a/b", "c"),
    ]


def test_toml(spark):
    f = spark.createDataFrame([("r", "a", TOML), ("r", "b", None)], "repo string, path string, text string")
    assert facts(settings.toml_facts(f)) == [
        (2, "package/name", "a"), (3, "package/version/workspace", "true"), (6, "dependencies/x", None), (6, "dependencies/x/features", '["a", "b"]'), (6, "dependencies/x/path", "../x"), (6, "dependencies/x/version", "1"),
        (7, "dependencies/y-z", "2"), (8, "dependencies/list", None), (9, "dependencies/list/#9", "one"), (10, "dependencies/list/#10", "two"), (12, "dependencies/after", None), (12, "dependencies/after/#12.0", "1"),
        (12, "dependencies/after/#12.1", "2"), (14, "bin/#13/name", "b]"), (16, "target/cfg(unix)/dependencies/u", "3"),
    ]


def test_long_files(spark):
    big = "a:\n" + "".join(f"  k{i}:\n    - v: {i}\n" for i in range(3_000))
    f = spark.createDataFrame([("r", "a", big)], "repo string, path string, text string")
    rows = settings.yaml_facts(f).filter("value IS NOT NULL")
    assert rows.count() == 3_000 and rows.filter("size(keys) = 4").count() == 3_000
    assert settings.yaml_facts(f.limit(0)).count() == 0 and settings.toml_facts(f.limit(0)).count() == 0
