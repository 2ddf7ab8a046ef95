import functools
import random
from decimal import Decimal

import pytest

from docquarry.kernel import model, pointer, printer
from docquarry.kernel.model import Members
from docquarry.kernel.parser import parse
from docquarry.kernel.patch import patch
from docquarry.kernel.printer import Style, to_text


@pytest.mark.parametrize(
    ("text", "out"),
    [("1.50", "1.5"), ("1E2", "100"), ("0.0001", "0.0001"), ("0.00001", "1e-5"), ("12345678901234567890", "1.234567890123456789e+19"), ("-0", "0"), ("0.0", "0"), ("-12.30e1", "-123"), ("1e16", "1e+16"), ("1e15", "1000000000000000"), ("9e-4", "0.0009"), ("0.5", "0.5"), ("123456789012345678.5", "123456789012345678.5")],
)
def test_number_text(text, out):
    assert model.number_text(Decimal(text)) == out


@pytest.mark.parametrize(
    ("text", "style", "out"),
    [
        ('{"a":1}', {"pretty": True}, '{"a": 1}'),
        ('{"a":[1]}', {"pretty": True}, '{\n    "a": [1]\n}'),
        ('{"a":1,"b":[1,2]}', {"pretty": True}, '{\n    "a": 1,\n    "b": [\n        1,\n        2\n    ]\n}'),
        ('{"a":1,"b":[1,2]}', {"pretty": True, "compact_array": True}, '{\n    "a": 1,\n    "b": [1, 2]\n}'),
        ("[[]]", {"pretty": True}, "[[]]"),
        ("{}", {"pretty": True}, "{}"),
        ('{"b":1,"a":{"d":1,"c":2}}', {"sorted": True}, '{"a":{"c":2,"d":1},"b":1}'),
        ('{"a b":1,"c":2,"True":3}', {"relaxed": True}, '{"a b":1,c:2,"True":3}'),
        ('"a/b\\u0001é"', {"escape_slash": True}, '"a\\/b\\u0001é"'),
        ("[1,2]", {"pretty": True, "tabs": True}, "[\n\t1,\n\t2\n]"),
    ],
)
def test_print(text, style, out):
    assert to_text(parse(text), Style(**style)) == out


def test_colored_text_is_the_same_text():
    import re

    value = parse('{"a":[1,null,"x"]}')
    assert re.sub("\x1b\\[[0-9]*m", "", to_text(value, Style(pretty=True, color=True))) == to_text(value, Style(pretty=True))


def test_escapes():
    text = 'a"\\\b\f\n\r\t/\x01é😀'
    assert model.unescape(model.escape(text)) == text == model.unescape(model.escape(text, slash=True))
    assert model.unescape(r"😀A") == "😀A"
    for bad in (r"\ud800", r"\q", "\\", r"\u12g4"):
        with pytest.raises(ValueError):
            model.unescape(bad)


def random_value(r: random.Random, depth: int = 4):
    kind = r.randrange(6 if depth else 4)
    if kind == 0:
        return r.choice([None, True, False])
    if kind == 1:
        return Decimal(r.randrange(-(10**20), 10**20)).scaleb(r.randrange(-25, 25))
    if kind in (2, 3):
        return "".join(r.choice('ab"\\/\n\x02é😀') for _ in range(r.randrange(5)))
    if kind == 4:
        return [random_value(r, depth - 1) for _ in range(r.randrange(4))]
    return Members((r.choice("abc"), random_value(r, depth - 1)) for _ in range(r.randrange(4)))


def shuffled(value, r):
    """An equal value: members of different names in another order, numbers written otherwise."""
    if isinstance(value, Members):
        names = list(dict.fromkeys(k for k, _ in value))
        r.shuffle(names)
        return Members((k, shuffled(v, r)) for n in names for k, v in value if k == n)
    if isinstance(value, list):
        return [shuffled(v, r) for v in value]
    return value


@pytest.mark.parametrize("seed", range(200))
def test_properties(seed):
    r = random.Random(seed)
    value = random_value(r)
    text = to_text(value)
    assert to_text(parse(text)) == text
    assert to_text(parse(to_text(value, Style(pretty=True)))) == text
    assert to_text(parse(to_text(value, Style(relaxed=True, pretty=True)), strict=False)) == text
    assert model.canonical(parse(model.canonical(value))) == model.canonical(value)
    assert model.equal(value, shuffled(value, r))
    assert to_text(model.copied(value)) == text
    for at, x in pointer.walk(value):
        if pointer.pointer_text(at).count("/") < 2:
            found = pointer.find(value, pointer.parse_pointer(pointer.pointer_text(at)))
            assert found is not pointer.NOTHING and (isinstance(x, list) or isinstance(value, Members) or found == x)
    other = random_value(r)
    assert model.compare(value, other) == -model.compare(other, value)
    assert (model.compare(value, other) == 0) == model.equal(value, other)


def test_order_of_types():
    values = [parse(t) for t in ("null", "false", "true", "1", "2", '""', '"a"', "[]", "[1]", "[1,1]", "[2]", "{}", '{"a":1}')]
    assert all(model.compare(a, b) == (i > j) - (i < j) for i, a in enumerate(values) for j, b in enumerate(values))
    assert model.sort_array(values[::-1]) == values


DOC = '{"number":16,"text":"Hello","array":[true,"x",42],"":"hidden","a/b":1,"~":2,"0":3,"d":1,"d":2}'


@pytest.mark.parametrize(("ptr", "out"), [("/number", "16"), ("/array/2", "42"), ("/array/0", "true"), ("/", '"hidden"'), ("/a~1b", "1"), ("/~0", "2"), ("/0", "3"), ("/d", "2"), ("/array/3", None), ("/array/-", None), ("/array/01", None), ("/nope", None), ("/text/0", None), ("/array/²", None)])
def test_find(ptr, out):
    found = pointer.find(parse(DOC), pointer.parse_pointer(ptr))
    assert (None if found is pointer.NOTHING else to_text(found)) == out


def test_pointers():
    assert pointer.parse_pointer("") == [] and pointer.parse_pointer("/") == [""]
    with pytest.raises(pointer.PointerError):
        pointer.parse_pointer("a")
    assert pointer.pointer_text(["a/b", "~1", ""]) == "/a~1b/~01/"
    assert pointer.parse_pointer("/~01") == ["~1"]


PATCHES = [
    ('{"foo":"bar"}', '[{"op":"add","path":"/baz","value":"qux"}]', '{"foo":"bar","baz":"qux"}', "patch_ok"),
    ('{"foo":["bar","baz"]}', '[{"op":"add","path":"/foo/1","value":"qux"}]', '{"foo":["bar","qux","baz"]}', "patch_ok"),
    ('{"baz":"qux","foo":"bar"}', '[{"op":"remove","path":"/baz"}]', '{"foo":"bar"}', "patch_ok"),
    ('{"foo":["bar","qux","baz"]}', '[{"op":"remove","path":"/foo/1"}]', '{"foo":["bar","baz"]}', "patch_ok"),
    ('{"baz":"qux"}', '[{"op":"replace","path":"/baz","value":"boo"}]', '{"baz":"boo"}', "patch_ok"),
    ('{"foo":{"bar":"baz","waldo":"fred"},"qux":{}}', '[{"op":"move","from":"/foo/waldo","path":"/qux/thud"}]', '{"foo":{"bar":"baz"},"qux":{"thud":"fred"}}', "patch_ok"),
    ('{"foo":["all","grass","cows","eat"]}', '[{"op":"move","from":"/foo/1","path":"/foo/3"}]', '{"foo":["all","cows","eat","grass"]}', "patch_ok"),
    ('{"a":1}', '[{"op":"move","from":"/a","path":"/ab"}]', '{"ab":1}', "patch_ok"),
    ('{"a":{"b":1}}', '[{"op":"move","from":"/a","path":"/a/b"}]', '{"a":{"b":1}}', "patch_invalid"),
    ('{"a":1}', '[{"op":"move","from":"/b","path":"/b"}]', '{"a":1}', "patch_noent"),
    ('{"a":[1]}', '[{"op":"copy","from":"/a/-","path":"/b"}]', '{"a":[1]}', "patch_noent"),
    ('{"a":[1,2]}', '[{"op":"move","from":"/a/0","path":"/a/9"}]', '{"a":[1,2]}', "patch_noent"),
    ("{}", '[{"op":"add","path":"/a~1b","value":1},{"op":"remove","path":"/a~1b"}]', "{}", "patch_ok,patch_ok"),
    ("[1,2]", '[{"op":"remove","path":"/-"},{"op":"replace","path":"/-","value":9}]', "[9]", "patch_ok,patch_ok"),
    ("[1]", '[{"op":"add","path":"/2","value":1}]', "[1]", "patch_noent"),
    ("1", '[{"op":"remove","path":""}]', "null", "patch_ok"),
    ('{"a":1}', '[{"op":"test","path":"/a","value":1.0},{"op":"test","path":"/a","value":2},{"op":"test","path":"/b","value":2}]', '{"a":1}', "patch_ok,patch_fail,patch_noent"),
    ("{}", '[{"op":"add","path":"/a"},{"op":"zap","path":"/a"},{"op":"add","op":"add","path":"/a","value":1},{"op":"add","path":"a","value":1},3]', "{}", ",".join(["patch_invalid"] * 5)),
    ('{"a":1}', '{"op":"copy","from":"/a","path":"/b"}', '{"a":1,"b":1}', "patch_ok"),
]


@pytest.mark.parametrize(("doc", "operations", "after", "results"), PATCHES)
def test_patch(doc, operations, after, results):
    before = parse(doc)
    ok, got, value = patch(before, parse(operations))
    assert (to_text(value), ",".join(got)) == (after, results) and ok == (set(got) == {"patch_ok"})
    assert to_text(before) == doc


def test_patch_options():
    steps = parse('[{"op":"add","path":"/b","value":1},{"op":"remove","path":"/c"}]')
    assert to_text(patch(parse('{"a":1}'), steps, atomic=True)[2]) == '{"a":1}'
    assert patch(parse("[1]"), parse('[{"op":"remove","path":"/-"}]'), rfc=True)[1] == ["patch_noent"]


def some_value(rng, depth=3):
    kind = rng.randrange(6 if depth else 4)
    if kind < 4:
        return (None, rng.random() < 0.5, Decimal(rng.choice(("1", "1.0", "-0", "0", "2e1", "20"))), rng.choice(("", "a", '"\\/', "\x00\x1f\x7f\n\b", "é😀")))[kind]
    items = [some_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return items if kind == 4 else model.Members((rng.choice("abc"), x) for x in items)


def test_equality_sorts_only_members_of_repeated_names(monkeypatch):
    rng = random.Random(5)
    pairs = [(some_value(rng), some_value(rng)) for _ in range(3000)] + [(parse('{"a":1,"b":[{"c":2,"d":3}]}'), parse('{"b":[{"d":3.0,"c":2}],"a":1.0}'))]
    pairs += [(a, model.Members(reversed(a)) if isinstance(a, model.Members) else a) for a, _ in pairs]
    assert {True, False} == {model.equal(a, b) for a, b in pairs}
    for a, b in pairs:
        assert model.equal(a, b) is (model.canonical(a) == model.canonical(b))
    deep = lambda end: parse("[" * 3000 + end + "]" * 3000)
    assert model.equal(deep('{"a":1,"b":2}'), deep('{"b":2,"a":1}')) and not model.equal(deep("1"), deep("2"))
    monkeypatch.setattr(model, "by_name", None)
    assert model.equal(parse('{"a":1,"b":[{"c":2,"d":3}]}'), parse('{"b":[{"d":3.0,"c":2}],"a":1.0}'))


def test_compact_text_is_quoted_as_other_styles_do(monkeypatch):
    rng = random.Random(6)
    values = [some_value(rng) for _ in range(2000)] + ["".join(map(chr, range(0x100))), "\ud800", parse("[" * 3000 + '"\\u0001"' + "]" * 3000)]
    for x in values:
        assert printer.to_text(x) == printer._printed(x, printer._COMPACT)
    monkeypatch.setattr(printer, "escape", None)  # no pattern of ours
    assert printer.to_text(parse('{"a\\n":["\\u0001","/"]}')) == '{"a\\n":["\\u0001","/"]}'


def test_patches_read_a_pointer_once_and_leave_the_document(monkeypatch):
    from docquarry.kernel import patch

    steps = parse('[{"op":"add","path":"/once/-","value":[1]},{"op":"copy","from":"/once","path":"/z"}]')
    docs = [parse('{"once":[[2]]}') for _ in range(3)]
    read = []
    monkeypatch.setattr(patch, "_tokens", functools.lru_cache(lambda text: read.append(text) or patch.parse_pointer(text)))
    for doc in docs:
        ok, _, after = patch.patch(doc, steps)
        assert ok and printer.to_text(after) == '{"once":[[2],[1]],"z":[[2],[1]]}' and printer.to_text(doc) == '{"once":[[2]]}'
        after[0][1][1].append(None)
        assert printer.to_text(after[1][1]) == "[[2],[1]]" and printer.to_text(steps[0][2][1]) == "[1]"
    assert read == ["/once/-", "/z", "/once"]
    deep = parse("[" * 3000 + '{"a":[]}' + "]" * 3000)
    assert printer.to_text(model.copied(deep)) == printer.to_text(deep) and model.copied(deep)[0] is not deep[0]


def test_whole_numbers_are_read_without_a_function_of_ours():
    from docquarry.kernel import parser

    assert all(d.parse_int is Decimal for d in parser._DECODERS.values())
    for text in ("0", "-0", "7", "-12", "9" * 15, "9" * 16, "1" + "0" * 5000):
        loop = parser._Parser(text, True, True, 0, 0, 0).document()
        assert str(parse(text)) == str(loop) and type(parse(text)) is Decimal
