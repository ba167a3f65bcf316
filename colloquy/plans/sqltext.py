"""SQL text of scalar semantics for the oracle, written for DuckDB."""

from colloquy import fixed_values as V

STRIP_CHARS = " || ".join(f"chr({ord(c)})" for c in V.PYTHON_WHITESPACE)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP_CHARS})"


def verdict(x: str) -> str:
    return (
        f"CASE regexp_extract_all(lower({x}), '[a-z]+')[-1] WHEN 'wrong' THEN 'incorrect' "
        f"WHEN 'correct' THEN 'correct' WHEN 'incorrect' THEN 'incorrect' END"
    )


def strip_think(x: str) -> str:
    return (
        f"CASE WHEN strpos({x}, '</think>') > 0 THEN {strip(f'substr({x}, strpos({x}, {lit(V.THINK_CLOSE)}) + 8)')} "
        f"ELSE {x} END"
    )


def unfinished(x: str) -> str:
    return f"coalesce(contains({x}, '<think>') AND NOT contains({x}, '</think>'), false)"


def boxed_first(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '\\boxed\{{([^\}}]+)\}}', 1), '')"


def boxed_last(x: str) -> str:
    """Counts the braces before every place after each box; the last box that closes wins."""
    parts = f"string_split({x}, chr(92) || 'boxed{{')"
    count = lambda brace: f"length(substr(r, 1, p)) - length(replace(substr(r, 1, p), '{brace}', ''))"
    closes = f"list_min(list_filter(range(1, length(r) + 1), lambda p: 1 + {count('{')} - ({count('}')}) = 0))"
    content = f"list_transform([array_to_string({parts}[i + 1:], chr(92) || 'boxed{{')], lambda r: substr(r, 1, {closes} - 1))[1]"
    each = f"list_transform(range(len({parts}) - 1, 0, -1), lambda i: {content})"
    return f"nullif(list_filter({each}, lambda b: b IS NOT NULL)[1], '')"


def tag(x: str, name: str) -> str:
    return strip(f"regexp_extract_all({x}, '(?is)<{name}>(.*?)</{name}>', 1)[1]")


def normalised(x: str) -> str:
    bare = rf"regexp_replace({strip(x)}, '\\left|\\right|\$|[ \t\r\n]', '', 'g')"
    bare = rf"regexp_replace({bare}, '\\[dt]frac', '\\frac', 'g')"
    bare = rf"regexp_replace({bare}, '\.$', '')"
    bare = rf"regexp_replace({bare}, '^([+-]?)\\frac\{{([^{{}}]+)\}}\{{([^{{}}]+)\}}$', '\1\2/\3')"
    return (
        rf"CASE WHEN regexp_matches({bare}, '^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]*)?$') "
        rf"THEN replace({bare}, ',', '') ELSE {bare} END"
    )


_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def number(x: str) -> str:
    """Number written by a normalised answer (``x`` should be a column)."""
    return (
        f"CASE WHEN regexp_matches({x}, '^{_NUMBER}$') THEN try_cast({x} AS DOUBLE) "
        f"WHEN regexp_matches({x}, '^{_NUMBER}/{_NUMBER}$') THEN try_cast(split_part({x}, '/', 1) AS DOUBLE) "
        f"/ nullif(try_cast(split_part({x}, '/', 2) AS DOUBLE), 0) END"
    )


def simple_grade(answer: str, truth: str) -> str:
    """Exact for the views, whose boxes hold one digit."""
    return f"coalesce({boxed_first(answer)} = {truth}, false)"


def verify(question: str, answer: str, note: str | None = None) -> str:
    extra = f" || CASE WHEN {note} THEN {lit(V.JUDGED_UNFINISHED_NOTE)} ELSE '' END" if note else ""
    return (
        f"({lit(V.JUDGED_VERIFY_INSTRUCTION)}{extra} || {lit(V.QUESTION_LABEL)} || {question} "
        f"|| {lit(V.PREVIOUS_ANSWER_LABEL)} || {answer})"
    )


def verify_shown(question: str, raw: str) -> str:
    """The verifier's user turn for a generator's raw text."""
    return verify(question, f"CASE WHEN {unfinished(raw)} THEN {raw} ELSE {strip_think(raw)} END", unfinished(raw))


def regenerate(question: str, feedback: str) -> str:
    return (
        f"({lit(V.JUDGED_REGENERATE_INSTRUCTION)} || {lit(V.QUESTION_LABEL)} || {question} "
        f"|| {lit(V.VERIFIER_FEEDBACK_LABEL)} || {feedback})"
    )


def tagged_verify(question: str, answer: str) -> str:
    return f"({lit(V.TAGGED_QUESTION_LABEL)} || {question} || {lit(V.TAGGED_ANSWER_LABEL)} || {answer})"


def msg(role: str, content: str) -> str:
    return f"{{'role': '{role}', 'content': {content}}}"


def text_json(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def canonical(messages: str) -> str:
    """Canonical JSON of a message list: sorted keys, blanks after comma and colon."""
    one = (
        "'{\"content\": ' || coalesce(CAST(to_json(m.content) AS VARCHAR), 'null') "
        "|| ', \"role\": ' || coalesce(CAST(to_json(m.role) AS VARCHAR), 'null') || '}'"
    )
    return f"'[' || coalesce(array_to_string(list_transform({messages}, lambda m: {one}), ', '), '') || ']'"
