import random
import time

import pytest

from docquarry.kernel import parser
from docquarry.kernel.lexer import tokens
from docquarry.kernel.model import canonical
from docquarry.kernel.parser import ParseError, is_valid, parse
from docquarry.kernel.printer import to_text

ACCEPTED = ["{}", "[]", "0", "-0", "1e5", "1.5E-3", '""', "null", " [1 , 2]\r\n", '{"":0}', '{"a":1,"a":2}', r'"😀"', '"\x7f"', '["é"]', "[" * 3000 + "]" * 3000]
REJECTED = [
    ("", "eob"), (" \n", "eob"), ("[1,]", "misplaced_right_bracket"), ('{"a":1,}', "expected_obj_member_name"), ("{a:1}", "invalid_token"), ('"a" "b"', "unexpected_character"), ("1 2", "unexpected_character"),
    ("01", "invalid_number"), ("1.", "invalid_number"), ("-", "invalid_number"), ("1e", "invalid_number"), ("+1", "unexpected_character"), (".5", "unexpected_character"), ("NaN", "invalid_token"), ("nul", "invalid_token"),
    (r'"\x"', "invalid_escape_code"), (r'"\u12"', "invalid_escape_code"), ('"a\tb"', "unterminated_string"), ('"a', "unterminated_string"), (r'"\ud800"', "invalid_utf8"), ("[", "unterminated_array"), ("{", "unterminated_object"),
    ('{"a"', "unterminated_object"), ('{"a":', "unterminated_object"), ("[1", "unterminated_array"), ("[1 2]", "expected_separator_or_right_bracket"), ('{"a":1 "b":2}', "expected_separator_or_right_curly_bracket"),
    ('{"a" 1}', "expected_colon"), ("{1:2}", "expected_obj_member_name"), ("]", "misplaced_right_bracket"), ("}", "misplaced_right_curly_bracket"), (",", "misplaced_separator"), (":", "misplaced_colon"),
    ("/* c */ 1", "unexpected_character"), ("1e99999999999999999999", "number_out_of_range"),
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(text):
    assert is_valid(text) and is_valid(text, strict=False)


@pytest.mark.parametrize(("text", "code"), REJECTED)
def test_rejected(text, code):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.code == code


def test_bytes_must_be_utf8():
    assert parse('"é"'.encode()) == "é"
    with pytest.raises(ParseError) as e:
        parse(b'[1,\n"\xc3("]')
    assert (e.value.code, e.value.row, e.value.col) == ("invalid_utf8", 1, 1)


@pytest.mark.parametrize(
    ("text", "same"),
    [("[1,]", "[1]"), ('{"a":1,}', '{"a":1}'), ("{a:1,_b2:2}", '{"a":1,"_b2":2}'), ('"a" "b" /* c */ "c"', '"abc"'), ("/* a **/ 1 // d", "1"), ('{"a" "b":["x"\n"y"]}', '{"ab":["xy"]}'), ("{null:1}", None), ("[,]", None), ("[1,,2]", None), ("/* open", None)],
)
def test_relaxed(text, same):
    if same is None:
        assert not is_valid(text, strict=False)
    else:
        assert to_text(parse(text, strict=False)) == same
        assert not is_valid(text)


def test_positions_and_messages():
    with pytest.raises(ParseError) as e:
        parse('{"a":1,\n "é":01}')
    assert (e.value.row, e.value.col, str(e.value)) == (1, 6, "Invalid number at line 2, column 6")


def test_limits():
    assert is_valid("[[1]]", max_depth=2) and not is_valid("[[1]]", max_depth=1)
    assert is_valid("[1,2]", max_array_size=2) and not is_valid("[1,2,3]", max_array_size=2)
    assert is_valid('{"a":1}', max_object_size=1) and not is_valid('{"a":1,"b":2}', max_object_size=1)
    assert not is_valid('{"a":1,"a":2}', allow_duplicates=False)
    assert not is_valid('{"a":1,"\\u0061":2}', allow_duplicates=False)
    assert is_valid('[{"a":1},{"a":2}]', allow_duplicates=False)


def test_both_parsers_agree():
    for text in ACCEPTED:
        assert canonical(parse(text)) == canonical(parse(text, max_depth=10**6))


def test_tokens():
    got = [(t.type, t.row, t.col, t.data) for t in tokens('{"a":\n [1, true]}')]
    assert got == [("LCBRACK", 0, 0, "{"), ("STRING", 0, 1, "a"), ("COLON", 0, 4, ":"), ("LBRACK", 1, 1, "["), ("NUMBER", 1, 2, "1"), ("SEPARATOR", 1, 3, ","), ("TRUE", 1, 5, "true"), ("RBRACK", 1, 9, "]"), ("RCBRACK", 1, 10, "}")]
    assert [t.type for t in tokens("a /*x*/ // y", strict=False)] == ["IDENTIFIER", "COMMENT", "COMMENT"]
    last = list(tokens("[1.]"))[-1]
    assert (last.type, last.error) == ("INVALID", "err_number_no_frac")
    assert [list(tokens(t))[-1].error for t in ("-", "1e", "tru", '"\\q"', '"x')] == ["err_number_lone_minus", "err_number_no_exp", "err_invalid", "err_string_escape", "err_string_unterminated"]


def test_errors_behind_strings_keep_their_code():
    for text, code in (('["a" $]', "unexpected_character"), ('"a" "b"', "unexpected_character"), ('{"a" "unterminated', "unterminated_string"), ('["\\u0041" tru]', "invalid_token")):
        with pytest.raises(ParseError) as e:
            parse(text)
        assert e.value.code == code


@pytest.mark.parametrize("end", ["}", ",}", ", oops", ""])
def test_long_lines_take_time_in_proportion(end):
    """Relaxed, escaped and malformed documents of one line."""
    import time

    def seconds(n):
        text = "{" + ",".join(f'"k{i}": [1, "\\u00e9\\ud83d\\ude00"]' for i in range(n)) + end
        began = time.perf_counter()
        for strict in (True, False):
            try:
                parse(text, strict=strict)
            except ParseError:
                pass
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(20_000) for _ in range(2)) < 60 * max(min(seconds(1000) for _ in range(3)), 1e-3)


def outcome(read):
    try:
        return to_text(read())
    except ParseError as e:
        return (e.code, e.row, e.col)


def test_relaxed_text_is_made_strict_as_the_token_loop_reads_it(monkeypatch):
    """Any mixture of parts has the value, or the error, of the token loop."""
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"b" "c"', '"/*"', '"//"', '"', "'", "\\", "a", "_b1", "é", "null", "true", "NaN", "Infinity", "-", "1", "0", ".5", "1e5", "1E", "e5", " ", "\n", "/", "/* , */", "/* \" */", "// x\n", "//", "/*", "*/", r'"\ud83d"', r'"\ude00"', r'"\u00e9\n"', r'"\q"', '"\ud800"', "#", "\x00", "\xa0", "\ufeff"]
    documents = ["{a:1,'b':[1,],}", '{"a" /*"x"*/ "b":{c:[ "d"//y\n"e" , ],},}', "[[,],{,},[1,,]]", "{a /*:*/ :/*,*/ -1.50e1 ,}// end", "[a:1]", '["\\ud83d" "\\ude00"]']
    rng, texts = random.Random(11), list(documents)
    for _ in range(20_000):
        texts.append("".join(rng.choices(parts, k=rng.randint(1, 8))))
        doc = rng.choice(documents)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(doc) + 1)
            doc = doc[:at] + rng.choice(parts) + doc[at + rng.randint(0, 2) :]
        texts.append(doc)
    for text in texts:
        for duplicates in (True, False):
            assert outcome(lambda: parse(text, strict=False, allow_duplicates=duplicates)) == outcome(lambda: parser._Parser(text, False, duplicates, 0, 0, 0).document()), text
    monkeypatch.setattr(parser, "_Parser", None)  # these do without the token loop
    for text in ('/* c */ { id : 5, "text": "a" "b", list: [1, 7,], } // end', documents[1], documents[3], '{"u":"\\u00e9" "é"}'):
        parse(text, strict=False)


def test_relaxed_text_takes_time_by_its_length():
    for text in (",/*" * 40_000, "[" + "a" * 100_000, '"a" ' * 40_000, "a /**/" * 40_000 + ":", "[,/**/" * 20_000, "/*" * 60_000, "[" + "1,/* c */" * 30_000 + "]", "{" + "a /* c */ : 1 ,\n" * 20_000 + "}"):
        began = time.perf_counter()
        is_valid(text, strict=False)
        assert time.perf_counter() - began < 5
