"""Web addresses as the URL standard reads them: hosts in ASCII, dot segments resolved, what needs it percent-encoded.

Built-in functions do for nearly all addresses; `needs_parsing` says for which they don't.
"""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are percent-encoded in each part, beside controls and what isn't ASCII, and such that no host has.
PATH, QUERY, USERINFO = ' "#<>?^`{}', " \"#<>'", ' "#<>?^`{}/:;=@[\\]|'
NO_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
PORTS = {"http": "80", "https": "443"}

#: A plain address: lower-case host of letters and digits, no dot segments, nothing that is to be encoded.
_PLAIN = r"^https?://(?:[!$&-,.0-9;=A-Z_a-z~:%-]*@)?[a-z0-9-]+(?:\.[a-z0-9-]+)*(?::[1-9][0-9]{0,3})?(?:/[!$-;=@-\[\]_a-z|~]*)?(?:\?[!$-&(-;=?-~]*)?(?:#[!$-;=?-_a-z{-~]*)?$"
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:[/?#]|$)"
_NUMBER_END = r"^https?://(?:[^/?#]*@)?[^/?#:]*[0-9](?::[0-9]+)?(?:[/?#]|$)"


def _encode(text: str, more: str) -> str:
    out = []
    for c in text:
        if "\x20" < c < "\x7f" and c not in more:
            out.append(c)
        else:
            out += [f"%{b:02X}" for b in c.encode("utf-8", "replace")]
    return "".join(out)


def _number(part: str) -> int | None:
    if part.lower().startswith("0x"):
        digits, base = part[2:] or "0", 16
    elif len(part) > 1 and part[0] == "0":
        digits, base = part[1:], 8
    else:
        digits, base = part, 10
    try:
        return int(digits, base) if re.fullmatch("[0-9A-Fa-f]+", digits) else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """A host whose last label is a number, as an address; null where it isn't one."""
    parts = host.removesuffix(".").split(".")
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    whole = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") and "%" not in raw else None
        except ValueError:
            return None
    try:
        text = unquote_to_bytes(raw.encode("utf-8")).decode("utf-8")
        for dot in "。．｡":
            text = text.replace(dot, ".")
        host = text.lower() if text.isascii() else text.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    if not host or NO_HOST.search(host):
        return None
    last = host.removesuffix(".").rsplit(".", 1)[-1]
    return _ipv4(host) if last and (last.isdigit() or _number(last) is not None and last.lower().startswith("0x")) else host


def normalize(address: str) -> str | None:
    """An http or https address in its normal form, or null where it is none."""
    found = re.match(r"(?i)(https?):[/\\]*", address)
    if not found:
        return None
    scheme = found[1].lower()
    rest, mark, fragment = address[found.end() :].partition("#")
    rest, asked, query = rest.partition("?")
    cut = re.search(r"[/\\]", rest)
    authority, path = (rest, "") if cut is None else (rest[: cut.start()], rest[cut.start() :])
    user, at, place = authority.rpartition("@")
    host, port = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", place, re.S).groups() if re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", place, re.S) else ("", None)
    shown = _host(host)
    if shown is None or port and (not port.isdecimal() or not port.isascii() or int(port) > 65_535):
        return None
    port = str(int(port)) if port else ""
    name, colon, word = user.partition(":")
    who = _encode(name, USERINFO) + (":" + _encode(word, USERINFO) if word else "")
    segments: list[str] = []
    parts = re.split(r"[/\\]", path)[1:] or [""]
    for i, part in enumerate(parts):
        dots = re.sub("(?i)%2e", ".", part)
        if dots == "..":
            segments = segments[:-1]
        elif dots != ".":
            segments.append(_encode(part, PATH))
            continue
        if i == len(parts) - 1:
            segments.append("")
    out = f"{scheme}://{who + '@' if who else ''}{shown}{':' + port if port and port != PORTS[scheme] else ''}/{'/'.join(segments)}"
    return out + ("?" + _encode(query, QUERY) if asked else "") + ("#" + _encode(fragment, ' "<>`') if mark else "")


def needs_parsing(url: Column) -> Column:
    """Whether an address may differ from its normal form in more than its case of scheme, default port or empty path."""
    return ~url.rlike(_PLAIN) | url.rlike(_DOTS) | url.rlike(_NUMBER_END)


def normal_form(url: Column) -> Column:
    """The normal form of web addresses, null for what is none; plain ones pass as they are and cost no parsing."""
    parsed = F.pandas_udf(lambda urls: pd.Series([None if u is None else normalize(u) for u in urls], dtype="object"), "string")
    odd = needs_parsing(url)
    return F.when(odd, parsed(F.when(odd, url))).otherwise(url)
