import pytest
from pyspark.sql import functions as F

from mergelens.llm.generated_files import classify_files, content_class, hand_written

CODE = "@@ -0,0 +1,3 @@\n+fun a(b: Int) = b + 1\n+// a remark\n+val c = a(2)"

PATHS = [
    ("package-lock.json", "lockfile"),
    ("./tools/x/Composer.LOCK", "lockfile"),
    ("config/door_lock.json", "hand_written"),
    ("src/lock_screen.py", "hand_written"),
    ("vendor/example.test/a/b.go", "vendored"),
    ("src/main/kotlin/shop/vendor/A.kt", "hand_written"),
    ("internal/vendors/a.go", "hand_written"),
    ("web/bower_components/a/b.js", "vendored"),
    ("external/lib-1.18/src/a.js", "vendored"),
    ("build\\generated\\a\\B.kt", "generated"),
    ("build-logic/src/A.kt", "hand_written"),
    ("api/a.pb.go", "generated"),
    ("planning/a_pb2.py", "generated"),
    ("app/A.g.kt", "generated"),
    ("web/A.generated.ts", "generated"),
    ("docs/generated-columns.md", "hand_written"),
    ("tools/generator/AGenerator.kt", "hand_written"),
    ("web/src/__snapshots__/A.snap", "generated"),
    ("Web/Static/A.MIN.JS", "minified"),
    ("web/js/min/a-min-heap.js", "hand_written"),
    ("dist/app.69771062.js", "minified"),
    ("geo/distance/dist_key.py", "hand_written"),
    ("static/a.js.map", "minified"),
    (None, "hand_written"),
]


def test_paths(spark):
    df = spark.createDataFrame([(i, p, CODE, "x") for i, (p, _) in enumerate(PATHS)], "diff_id int, file_path string, patch string, by_path string")
    got = {r.diff_id: r.file_class for r in classify_files(df).collect()}
    assert {p: got[i] for i, (p, _) in enumerate(PATHS)} == dict(PATHS)
    assert {c for c in hand_written(df).columns} == set(df.columns)


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ("// Code generated by x. DO NOT EDIT.", "generated"),
        ("# Automatisch erzeugt mit x - nicht bearbeiten", "generated"),
        ('@Generated("kapt")', None),
        ("// @generated SignedSource<<1234>>", "generated"),
        ("/*! lib v1.2.3 | (c) the authors | MIT License */", "vendored"),
        ("// @preserve lib 1.2.3, copied unchanged from upstream", "vendored"),
        ("# rewritten by hand, was generated by a script", None),
        ('out.println("// Code generated by x. DO NOT EDIT.")', None),
        ("/** Says hello. */", None),
    ],
)
def test_notices(head, want):
    patch = f"@@ -0,0 +1,3 @@\n+{head}\n+fun a() = 1\n+fun b() = 2"
    assert (content_class("a.kt", patch) or None) == (want or ("generated" if head.startswith("@Gen") else None))
    late = "@@ -1,40 +1,41 @@\n" + " fun a() = 1\n" * 40 + f"+{head}"
    assert content_class("a.kt", late) is None


def test_shapes():
    mini = "@@ -0,0 +1 @@\n+" + "!function(a,b){a.c()}(e,t);var d=z||{};d.e=1;" * 20
    table = "@@ -0,0 +1,9 @@\n+const T = [\n" + "+  48612,24181,35543,61231,56519,39008,26302,47568,\n" * 9 + "+];"
    blob = "@@ -0,0 +1,9 @@\n+DATA = (\n" + '+    "Pbzd9n4Nhe5qmyg5Sk4n5F8gD4Dm16alf5QuMSryNy8wq9tupSpk/l9VqvLNpfbXI"\n' * 9 + "+)"
    prose = "@@ -0,0 +1 @@\n+  const help = '" + "order window policy cart " * 60 + "';"
    assert content_class("a.js", mini) == "minified" and content_class("a.md", mini) is None
    assert content_class("a.js", table) == content_class("a.py", blob) == "data"
    assert content_class("a.ts", prose) is None


def test_edges(spark):
    df = spark.createDataFrame([(1, "a.lock", None), (2, "a.kt", ""), (2, "a.kt", ""), (3, None, None)], "diff_id int, file_path string, patch string").withColumn("file_class", F.lit(9))
    assert sorted((r.diff_id, r.file_class) for r in classify_files(df).collect()) == [(1, "no_patch"), (2, "hand_written"), (2, "hand_written"), (3, "no_patch")]
    assert classify_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", ["# This file was generated by protoc", "// This code was generated by a tool", "// Sources were generated from x.proto"])
def test_notices_in_the_past(head):
    assert content_class("a.kt", f"@@ -0,0 +1,3 @@\n+{head}\n+fun a() = 1\n+fun b() = 2") == "generated"
    assert content_class("a.kt", f"@@ -0,0 +1,3 @@\n+{head}, now maintained by hand\n+fun a() = 1\n+fun b() = 2") is None


LICENCE = ["Copyright the authors", *(f"line {i} of the licence" for i in range(20))]


@pytest.mark.parametrize("sign", ["+", "-"])
@pytest.mark.parametrize(
    ("path", "head"),
    [
        ("a.go", [f"// {x}" for x in LICENCE] + ["", "// Code generated by x. DO NOT EDIT."]),
        ("a.kt", ["/*", *LICENCE, "This file is generated by x", "*/"]),
        ("a.py", ['"""', *LICENCE, "This file is generated by x", '"""']),
        ("a.php", ["<?php", "/*", *[f" * {x}" for x in LICENCE], " */", "// @generated"]),
        ("a.ml", ["(*", *LICENCE, "generated by x", "*)"]),
    ],
)
def test_whole_head_on_either_side(sign, path, head):
    at = f"-0,0 +1,{len(head) + 1}" if sign == "+" else f"-1,{len(head) + 1} +0,0"
    lines = [f"@@ {at} @@", *(sign + x for x in [*head, "let a = 1"]), "\\ No newline at end of file"]
    assert content_class(path, "\n".join(lines)) == "generated"
    plain = [x for x in lines if "enerated" not in x]
    assert content_class(path, "\n".join([*plain, *[sign + "let b = 2"] * 9, sign + "// generated by x"])) is None


def test_signs_of_other_languages_open_no_comment():
    patch = "@@ -0,0 +1,4 @@\n+(*p).a = 1;\n+{-1, 2};\n" + "+x = 1;\n" * 12 + "+y = \"generated by x\";"
    assert content_class("a.c", patch) is None


@pytest.mark.parametrize("sign", ["+", "-"])
def test_blobs_by_characters(sign):
    blob = "AGFzbQEAAAAB9/+x" * 40
    for code in (f'export const WASM = "{blob}";', f'data = (\n{sign}    "{blob[:300]}"\n{sign}    "{blob[300:]}"\n{sign})', "const T = [" + ", ".join(str(i * 7919 % 65536) for i in range(300)) + "];", 'b = b"' + "\\x1f\\x8b" * 60 + '"'):
        assert content_class("a.ts", f"@@ -0,0 +1 @@\n{sign}{code}\n") == "data"
    for code in (f'const KEY = "{blob[:64]}";', f'const A = "{blob[:300]}";\n' + f"{sign}fun a() = call(b)\n" * 40, "\n".join(sign + f'export * from "components/forms/inputs/text-input-with-label-{i}";' for i in range(9))[1:]):
        assert content_class("a.ts", f"@@ -0,0 +1 @@\n{sign}{code}") is None


def test_long_lines_of_data_cost_linear_time():
    import time

    began = time.time()
    for line in ("'" + "a" * 200_000, "'a" * 100_000, "1,2,3,a," * 50_000, "1" * 200_000 + "," * 20, "\\x1f" * 50_000):
        content_class("a.ts", f"@@ -0,0 +1 @@\n+x = {line}")
    assert time.time() - began < 5


@pytest.mark.parametrize("head", ["// Tokens generated by the auth service are cached here", "# Ids generated from the clock", "// Reads reports généré par the old job", "// Checks what was generated by hand-rolled code"])
def test_phrases_about_other_things(head):
    assert content_class("a.kt", f"@@ -0,0 +1,3 @@\n+{head}\n+fun a() = 1\n+fun b() = 2") is None


@pytest.mark.parametrize("head", ["// x.pb.go. Generated by protoc", "// Warning: this file was generated from a.proto", "# Diese Datei wurde generiert von xgen", "/* Ce fichier a été généré par xgen */", "-- generated with xgen 2.1", "// AUTO-GENERATED tokens"])
def test_phrases_about_the_file(head):
    assert content_class("a.kt", f"@@ -0,0 +1,3 @@\n+{head}\n+fun a() = 1\n+fun b() = 2") == "generated"
