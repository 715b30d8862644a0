"""Splitting of source files, by behaviour."""

from __future__ import annotations

import pytest

from kestrion.operators.definitions import ParseError, go, markdown, openapi, proto, rust, select_parser
from kestrion.operators.windows import MOST_CHARS, windows


def labels(chunks):
    return [label for label, _ in chunks]


def test_proto_kinds_nesting_and_comments():
    source = 'syntax = "proto3";\n\n// A thing.\n// Two lines.\nmessage Outer {\n  message Inner { string s = 1; }\n  string odd = 2 [default = "}{"]; // }\n  /* { */\n}\n\nenum Kind { NONE = 0; }\nservice Api {\n  rpc Do(Outer) returns (Outer);\n}\n'
    chunks = proto(source)
    assert labels(chunks) == ["message Outer", "enum Kind", "service Api"]
    assert chunks[0][1].startswith("// A thing.\n// Two lines.\nmessage Outer {") and chunks[0][1].endswith("\n}")


def test_proto_blank_line_ends_comment_and_crlf_is_normalised():
    chunks = proto("// far\n\nmessage A {\r\n}\r\n")
    assert chunks == [("message A", "message A {\n}")]


def test_proto_options_and_duplicates():
    source = 'option (x) = {\n  message: "no"\n};\nextend Foo {\n}\nmessage A {\n}\nmessage A {\n}\n  message Indented {\n  }\n'
    assert labels(proto(source)) == ["message A", "message A#2"]
    assert proto('syntax = "proto3";\n') == []


@pytest.mark.parametrize(("source", "kind"), [("message A {\n", "unterminated"), ("/* x\nmessage A {}\n", "unterminated_comment"), ("message {\n}\n", "malformed_header"), ("}\n", "unterminated")])
def test_proto_errors(source, kind):
    with pytest.raises(ParseError) as error:
        proto(source)
    assert error.value.kind == kind


GO = """package x

import (
	"fmt"
)

// Run runs.
func Run(a int) error {
	s := `}
	raw {{{`
	r := '{'
	return fmt.Errorf("}") // }
}

func hidden() {}

type Stack[T any] struct {
	items []T
}

func (s *Stack[T]) Push(x T) {
}

func (Buffer) Len() int { return 0 }

func (b *Buffer) secret() {}

// Limits.
const (
	// first
	Max = 1
	min = 2
)

var ErrX = 1
var errY = 2
var (
)
"""


def test_go():
    chunks = dict(go(GO))
    assert list(chunks) == ["func Run", "type Stack", "func Stack.Push", "func Buffer.Len", "const Max", "var ErrX", "var block"]
    assert chunks["func Run"].startswith("// Run runs.\nfunc Run") and chunks["func Run"].endswith("// }\n}")
    assert chunks["const Max"].startswith("// Limits.\nconst (")


def test_go_multiline_signatures_and_errors():
    source = "func Long(\n\ta int,\n\tb int,\n) (int, error) {\n\treturn 1, nil\n}\n"
    assert go(source) == [("func Long", source.rstrip())]
    for bad in ("func A() {\n", "/* open\n", "type T struct {\n x `raw\n"):
        with pytest.raises(ParseError):
            go(bad)


RUST = '''//! Crate docs.

use std::fmt;

/// A point.
#[derive(
    Debug,
)]
pub struct Point {
    x: i32,
}

struct Hidden;

pub(crate) const MAX: usize = 3;
pub const fn two() -> u8 { 2 }
pub async unsafe extern "C" fn odd<'a>(c: char) -> &'a str {
    let b = '{';
    let s = "}}}";
    let r = r#"}" { "#;
    /* { /* nested { */ } */
    "x"
}

pub mod inner {
    pub fn not_seen() {}
}
pub mod outside;
pub use self::inner::x;

impl<T: Fn(u8) -> u8> Wrap<T> {
    /// Makes one.
    pub fn new(t: T) -> Self {
        Wrap(t)
    }

    fn private(&self) {}
}

impl fmt::Display for inner::Point {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {
        Ok(())
    }
}

impl<T> Iterator
    for Walk<T>
where
    T: Clone,
{
    fn next(&mut self) -> Option<T> { None }
}

impl Marker for Point {}

pub trait Shape {
    fn area(&self) -> f64;
}
pub type Alias = Vec<u8>;
pub enum E { A, B }
'''


def test_rust():
    chunks = dict(rust(RUST))
    assert list(chunks) == ["struct Point", "const MAX", "fn two", "fn odd", "mod inner", "mod outside", "Wrap::new", "Point::fmt", "Walk::next", "trait Shape", "type Alias", "enum E"]
    assert chunks["struct Point"].startswith("/// A point.\n#[derive(\n") and chunks["struct Point"].endswith("}")
    assert chunks["mod inner"] == "pub mod inner" and chunks["mod outside"] == "pub mod outside;"
    assert chunks["Wrap::new"].startswith("    /// Makes one.\n")


def test_rust_duplicates_and_errors():
    source = "impl A {\n    pub fn x() {}\n}\nimpl T for A {\n    fn x() {}\n}\n"
    assert labels(rust(source)) == ["A::x", "A::x#2"]
    for bad in ("pub fn a() {\n", "/* /* */\n", "}\n"):
        with pytest.raises(ParseError):
            rust(bad)


def test_markdown():
    source = "# Title #\n\nIntro.\n\n## One ##\ntext\n```\n## no\n~~~\n```\n### sub\n## One\n## \nlast\n"
    chunks = markdown(source)
    assert labels(chunks) == ["Title", "One", "One#2", "(section)"]
    assert chunks[0][1] == "# Title #\n\nIntro.\n"
    assert "\n".join(c for _, c in chunks) == source.rstrip("\n")
    assert labels(markdown("# Only\n\n## A\n")) == ["A"] and labels(markdown("text\n")) == ["(preamble)"] and markdown("") == []


def test_openapi():
    pytest.importorskip("yaml")
    source = "openapi: 3.0.0\npaths:\n  /a:\n    get: {summary: x}\n    POST: {}\n    parameters: []\n    x-note: 1\n  /b: 3\ncomponents:\n  schemas:\n    S: {type: object}\ndefinitions:\n  D: {type: string}\n"
    chunks = openapi(source)
    assert labels(chunks) == ["GET /a", "POST /a", "schema S", "schema D"]
    assert chunks[0][1] == "# GET /a\nsummary: x"
    assert openapi("- a\n- b\n") == [] and openapi("") == [] and labels(openapi('{"paths": {"/x": {"get": {}}}}')) == ["GET /x"]
    with pytest.raises(ParseError):
        openapi("a: [1\nb: }")


def test_dispatch():
    assert select_parser("plan", "go", "go") is None and select_parser("meta", "scala", "sc") is None
    assert select_parser("meta", "unknown", "RS") is rust and select_parser("contract", "openapi", "yaml") is openapi and select_parser("meta", "scala", "proto") is proto


def test_windows():
    assert windows("", "f") == [("f", "", False)]
    lines = ("x" * 98 + "\n") * 400
    parts = windows(lines, "f")
    assert "".join(c for _, c, _ in parts) == lines and all(len(c) <= MOST_CHARS for _, c, _ in parts)
    parts = windows("head\n" + "y" * 11_000 + "\ntail", "f")
    assert [(len(c), cut) for _, c, cut in parts] == [(5, False), (MOST_CHARS, True), (4, False)]
    assert [x for x, _, _ in parts] == ["f", "f#2", "f#3"]
