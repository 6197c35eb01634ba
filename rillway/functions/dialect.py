"""A small common dialect: upper-case calls that the two engines spell differently."""

from __future__ import annotations

import re

_FORMS = {
    "spark": {
        "MS": "unix_millis(cast({0} as timestamp))", "IDIV": "(({0}) div ({1}))", "STR": "cast({0} as string)", "SHA": "sha2({0}, 256)",
        "H64": "cast(conv(substr(md5({0}), 1, 16), 16, 10) as decimal(20,0))", "LAGG": "listagg({0}, {1}) within group (order by {2})", "D": "cast({0} as double)", "B": "cast({0} as bigint)",
    },
    "check": {
        "MS": "(epoch_us({0}) // 1000)", "IDIV": "(({0}) // ({1}))", "STR": "cast({0} as varchar)", "SHA": "sha256({0})",
        "H64": "cast(concat('0x', substr(md5({0}), 1, 16)) as ubigint)", "LAGG": "string_agg({0}, {1} order by {2})", "D": "cast({0} as double)", "B": "cast({0} as bigint)",
    },
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    depth, parts, start, quoted = 0, [], at, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif c == ")" or (c == ";" and not depth):
            parts.append(text[start:i].strip())
            start = i + 1
            if c == ")":
                return parts, i + 1
        elif c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    raise ValueError(text)


def render(text: str, engine: str) -> str:
    """Expands the calls, innermost last; tables stay in braces for Spark and bare for the other engine."""
    forms = _FORMS[engine]
    pattern = re.compile(r"\b(" + "|".join(forms) + r")\(")
    while m := pattern.search(text):
        args, end = _arguments(text, m.end())
        text = text[: m.start()] + forms[m[1]].format(*args) + text[end:]
    return text if engine == "spark" else re.sub(r"\{(\w+)\}", r"\1", text)
