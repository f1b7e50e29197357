"""Driver-side parameters: option names, typed values, canonical queries, colours, projections."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from urllib.parse import quote


def camel(name: str) -> str:
    head, *rest = name.split("-")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def kebab(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "-" + m[0].lower(), name)


def encode(text: str) -> str:
    """Percent-encoded; commas stay."""
    return quote(text, safe=",-._~")


#: What kind of value an option takes.
KINDS = {"width": int, "height": int, "precision": int, "title": str, "caption": str, "labels": bool, "inset": bool, "languages": list, "projection": str, "bbox": str}


def typed(name: str, value: str):
    """A parameter's value by its option's kind."""
    kind = KINDS.get(name)
    if kind is None:
        raise ValueError(f"unknown parameter {name}")
    if kind is bool:
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{name} is true or false")
        return value.lower() in ("true", "1", "yes")
    if kind is list:
        return [x.strip() for x in value.split(",") if x.strip()]
    try:
        return kind(value)
    except ValueError:
        raise ValueError(f"{name}: {value!r} is not a number") from None


def parse_params(pairs: Iterable[tuple[str, str]], reserved: Iterable[str] = ()) -> dict:
    """Typed parameters; repeated and reserved names fail."""
    out: dict = {}
    for key, value in pairs:
        name = kebab(key)
        if name in out or name in reserved:
            raise ValueError(f"{key} is given twice" if name in out else f"{key} is reserved")
        out[name] = typed(name, value)
    return out


def canonical(params: Mapping[str, object]) -> str:
    """Sorted and encoded: equal parameters give equal text."""
    plain = lambda v: ",".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v)
    return "&".join(f"{encode(camel(k))}={encode(plain(v))}" for k, v in sorted(params.items()))


def wrap_words(text: str, chars: float) -> list[str]:
    """Lines of at most max(10, chars) characters, broken at blanks; long words stay whole."""
    most, out = int(max(chars, 10)), []
    for paragraph in text.splitlines():
        line = ""
        for word in paragraph.split():
            if line and len(line) + 1 + len(word) > most:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        if line:
            out.append(line)
    return out


def color(text: str) -> str:
    """A colour as #rrggbb, #rgb or a plain name."""
    t = text.strip().lower()
    if not re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})|[a-z]+", t):
        raise ValueError(f"not a colour: {text!r}")
    return t


PROJECTIONS = ("auto", "laea", "albers", "lcc", "equal-earth")


def projection_name(text: str) -> str:
    t = text.strip().lower()
    if t not in PROJECTIONS:
        raise ValueError(f"a projection is one of {', '.join(PROJECTIONS)}")
    return t


def parallels(text: str) -> tuple[float, float]:
    a, _, b = text.partition(",")
    south, north = float(a), float(b)
    if not -90 < south <= north < 90:
        raise ValueError("parallels are two latitudes, the southern one first")
    return south, north


def title_bands(width: int, title: str | None, show_title: bool, caption: str | None) -> tuple[int, list[str]]:
    """Height of the title band, and the caption's lines for the width."""
    band = round(width * 0.05) if title and show_title else 0
    return band, wrap_words(caption or "", width / 7.0)
