import ast
import asyncio
import json
from pathlib import Path

import pytest

from lodestone.operators.chunking import python_symbols
from lodestone.operators.recovery import definitions


def by_ast(source):
    found = []

    def visit(node, scope):
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = (*scope, child.name)
                found.append((".".join(inner), min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno))
            visit(child, inner)

    visit(ast.parse(source), ())
    return sorted(found)


FILES = sorted({p for m in (asyncio, json, ast) for p in Path(m.__file__).parent.glob("*.py")})[:150]


def test_whole_files_give_what_the_parser_finds():
    total = 0
    for path in FILES:
        source = path.read_text(errors="replace")
        wanted = by_ast(source)
        assert sorted(definitions(source)) == wanted, path
        total += len(wanted)
    assert total > 2000


WHOLE = """import os

@wraps
@other(1,
       2)
def first(x, y=(1, 2)) -> dict[str, int]:
    '''Doc with def inside(
    class Not:
    '''
    return {x: [y]}


{BROKEN}


class Box(Base, metaclass=Meta):
    limit = 3

    async def get(self,
                  key):
        if key:
            return key

    class Inner: value = 1


def last(): return 0
"""

BROKEN = [
    "def (",
    "def broken(x:\n    return x",
    "def broken(x)\n    return x",
    "x = [1, 2,",
    "x = {'a': (1, 2\ny = 3",
    "class :\n    pass",
    "if x\n    y = (",
    "print 'old'",
    "<<<<<<< ours\nx = 1\n=======\nx = 2\n>>>>>>> theirs",
    "x = 'never closed",
    "return = 3",
    "@\n",
]


@pytest.mark.parametrize("broken", BROKEN)
def test_all_other_symbols_come_out(broken):
    source = WHOLE.replace("{BROKEN}", broken)
    with pytest.raises(SyntaxError):
        ast.parse(source)
    lines = source.splitlines()
    found = {n: (a, b) for n, a, b in definitions(source)}
    place = lambda text: next(i for i, x in enumerate(lines, 1) if text in x)
    assert found["first"] == (place("@wraps"), place("return {x"))
    box = place("class Box")
    assert found["Box"] == (box, place("class Inner")) and found["Box.get"] == (place("async def"), place("return key"))
    assert found["Box.Inner"] == (place("class Inner"),) * 2 and found["last"] == (place("def last"),) * 2
    assert set(found) <= {"first", "Box", "Box.get", "Box.Inner", "last"}
    assert [(x[0], x[4], x[5].splitlines()[0]) for x in python_symbols(source) if x[0] == "Box"] == [("Box", "", lines[box - 1])]


def test_a_broken_body_keeps_its_function():
    source = "def whole(x):\n    return x +\n\n\nclass A:\n    def m(self):\n        y = (1,\n\n    def n(self):\n        pass\n"
    assert definitions(source) == [("whole", 1, 2), ("A", 5, 10), ("A.m", 6, 8), ("A.n", 9, 10)]


def test_quotes_that_are_never_closed():
    source = 'def a():\n    """no end\n    return 1\n\n\ndef b():\n    return 2\n'
    assert definitions(source) == [("a", 1, 3), ("b", 6, 7)]


def test_empty_and_strange_texts():
    for text in ("", "\n\n", "# only\n", ")))", "'''", "\\", "def", "class", "@", "\x0cdef f(): pass", "\tdef g():\n\t\tpass"):
        definitions(text)
    assert python_symbols("def f(:\n" * 3) == []
    assert [x[0] for x in python_symbols("(" * 5000 + "\ndef f():\n    pass")] == ["f"]


def test_chunks_of_many_files_are_put_out_in_parts():
    import pyarrow as pa

    from lodestone.operators import chunking

    files = pa.RecordBatch.from_pydict({"filepath": [f"{i}/README.md" for i in range(200)], "raw_content": ["# A\n" + "word " * 5000] * 200})
    parts = list(chunking._chunks_of_files([files]))
    assert sum(p.num_rows for p in parts) == 200 and len(parts) > 4 and max(p.nbytes for p in parts) < 2 * chunking.AT_ONCE
