"""Numeric patterns of to_char, compiled to SQL expressions.

A pattern is made of `9` and `0` (digits), `G` or `,` (group separator), `D` or `.` (decimal point, once),
after an optional `FM`, and is read as PostgreSQL does in locale C:

* a `9` before the first digit that counts is blank, a `0` and all digits after it are shown;
  separators before the first shown digit are blank;
* with a fraction, a whole part of 0 is not shown, unless by a `0`;
* the sign stands right before the first shown character; the text is one wider than the pattern;
* `FM` leaves out the padding and the fraction's last zeros down to its last `0` in the pattern, but not the
  point; a number without fraction then keeps its 0 before the point;
* a number with more whole digits than the pattern has `#` in every digit's place.

Numbers are rounded half away from zero to the pattern's decimals. NULL gives NULL.
"""

from __future__ import annotations

import re

MOST_DIGITS = 38


def _parsed(pattern: str) -> tuple[bool, str, str, bool]:
    """(FM, whole part, fraction, whether there is a point), with `,` and `.` written plainly."""
    fill, body = (True, pattern[2:]) if pattern.startswith("FM") else (False, pattern)
    plain = body.replace("G", ",").replace("D", ".")
    if not re.fullmatch(r"[90,]*(\.[90]*)?", plain) or not re.search("[90]", plain):
        raise ValueError(f"no numeric pattern: {pattern!r}")
    whole, point, fraction = plain.partition(".")
    if len(re.findall("[90]", whole)) + 2 * len(fraction) + 2 > MOST_DIGITS:
        raise ValueError(f"too many digits: {pattern!r}")
    return fill, whole, fraction, bool(point)


def number_text(value: str, pattern: str) -> str:
    """An expression that writes `value`, an expression of any numeric type, by the pattern."""
    fill, whole, fraction, point = _parsed(pattern)
    digits, decimals = len(re.findall("[90]", whole)), len(fraction)
    kind = f"decimal({max(digits + decimals, 1)}, {decimals})"
    scaled = f"abs(try_cast({value} as {kind})) * cast('1{'0' * decimals}' as decimal({decimals + 1}, 0))"
    # All digits of the pattern, whole part and fraction, with leading zeros.
    text = f"lpad(string(cast({scaled} as decimal({MOST_DIGITS}, 0))), {digits + decimals}, '0')"
    always = [i for i, c in enumerate(c for c in whole if c != ",") if c == "0"]
    first_always = always[0] + 1 if always else digits + 1

    def written(t: str, shown: str, kept: str) -> str:
        """`t`: the digits; `shown`: the place of the first shown one; `kept`: how many decimals stay."""
        parts, at = [], 0
        for c in whole:
            at += c != ","
            parts.append(f"if({at} >= {shown}, {repr(c) if c == ',' else f'substr({t}, {at}, 1)'}, '')")
        if point:
            parts.append("'.'")
        if decimals:
            parts.append(f"substr({t}, {digits + 1}, {kept})")
        return f"concat({', '.join(parts)})"

    leading = f"{digits} - length(trim(leading '0' from substr(t, 1, {digits}))) + 1"
    if not decimals:
        least = str(min(first_always, digits))  # a whole 0 is shown
    elif fill:
        no_fraction = f"trim(leading '0' from substr(t, {digits + 1})) = ''"
        least = f"if({no_fraction}, {min(first_always, digits)}, {first_always})"
    else:
        least = str(first_always)
    shown = f"least({leading}, {least})"
    last_always = max((i + 1 for i, c in enumerate(fraction) if c == "0"), default=0)
    kept = f"greatest(length(trim(trailing '0' from substr(t, {digits + 1}))), {last_always})" if fill else str(decimals)
    sign = f"if({value} < 0 and trim(leading '0' from t) <> '', '-', '')"
    body = f"concat({sign}, {written('t', shown, kept)})"
    full = re.sub("[90]", "#", whole) + "." * point + "#" * decimals
    overflow = f"concat(if({value} < 0, '-', ''), '{full}')"
    if not fill:
        width = 1 + len(whole) + point + decimals
        body, overflow = f"lpad({body}, {width}, ' ')", f"lpad({overflow}, {width}, ' ')"
    either = f"get(transform(array({text}), t -> if(t is null, {overflow}, {body})), 0)"
    return f"if({value} is null, null, {either})"
