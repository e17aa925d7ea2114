from factloom.operators.statements import statements

SOURCE = '''import a from "a";
import * as ns from 'b'
import d, { x as y, type T, z } from "c";
import type { U, V as W } from "d";
import "side";
import {
  one, // first
  two as deux,
} from "many";
export { p as q, r } from "e";
export * from "f";
export type { S } from "g"
export { local };
export const k = 1;
const { m = f(1, 2), n } = require("h");
const { o: { s, t }, u: v } = require("i")
let whole = require('j');
module.exports = require("k");
exports.part = require( "l" );
const plain = other("m");
import("n").then(x => x);
import { unfinished
const after = require("o");
import { open, more
} from "p";
  import late, * as all from "q"
const w = 1
'''


def test_statements_and_their_names():
    found = [(s.first + 1, s.last + 1, s.module, s.names, s.edge_kind, s.binds, s.method.removeprefix("lexical-")) for s in statements(SOURCE.splitlines())]
    assert found == [
        (1, 1, "a", ("a",), "imports", True, "import"), (2, 2, "b", ("ns",), "imports", True, "import"), (3, 3, "c", ("d", "y", "T", "z"), "imports", True, "import"),
        (4, 4, "d", ("U", "W"), "imports", False, "type-import"), (5, 5, "side", (), "imports", False, "side-effect-import"), (6, 9, "many", ("one", "deux"), "imports", True, "import"),
        (10, 10, "e", ("q", "r"), "exports", False, "re-export"), (11, 11, "f", (), "exports", False, "re-export"), (12, 12, "g", ("S",), "exports", False, "type-re-export"),
        (15, 15, "h", ("m", "n"), "imports", True, "require"), (16, 16, "i", ("v",), "imports", True, "require"), (17, 17, "j", ("whole",), "imports", True, "require"),
        (18, 18, "k", (), "exports", False, "commonjs-export-require"), (19, 19, "l", (), "exports", False, "commonjs-export-require"), (23, 23, "o", ("after",), "imports", True, "require"),
        (24, 25, "p", ("open", "more"), "imports", True, "import"), (26, 26, "q", ("late",), "imports", True, "import"),
    ]


def test_odd_sources():
    assert list(statements([])) == list(statements(["", "  "])) == list(statements(["import"])) == list(statements(["export {"])) == []
    assert [s.names for s in statements(['import type from "t"', 'import type, { a } from "u"', 'import {} from "v"'])] == [("type",), ("type", "a"), ()]
    long = ["import {"] + [f"  name{i}," for i in range(5_000)] + ['} from "big"']
    assert [len(s.names) for s in statements(long)] == [5_000]
