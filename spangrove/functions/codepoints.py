"""Patterns over explicit ranges of code points, for @builder terminals."""

from __future__ import annotations

import regex

# ASCII members as they are, other ranges of code points in hexadecimal. Identifier heads, then what else may
# continue an identifier.
# Three of them are wider or narrower than the language's published grammar: F8FF (not F900) begins the block of CJK
# compatibility characters, 180E is not left out, and FFF8 (not FFFD) ends the basic plane.
IDENTIFIER_ASCII = "A-Za-z_"
IDENTIFIER_HEAD = """
A8 AA AD AF B2-B5 B7-BA BC-BE C0-D6 D8-F6 F8-2FF 370-167F 1681-1DBF 1E00-1FFF 200B-200D 202A-202E
203F-2040 2054 2060-20CF 2100-218F 2460-24FF 2776-2793 2C00-2DFF 2E80-2FFF 3004-3007 3021-302F 3031-D7FF F8FF-FD3D
FD40-FDCF FDF0-FE1F FE30-FE44 FE47-FFF8
"""
DIGITS = "0-9"
IDENTIFIER_MORE = "300-36F 1DC0-1DFF 20D0-20FF FE20-FE2F"
# Operator heads, then what else may continue an operator.
OPERATOR_ASCII = "/=-+!*%<>&|^~?"
OPERATOR_HEAD = """
A1-A7 A9 AB-AC AE B0-B1 B6 BB BF D7 F7 2016-2017 2020-2027 2030-203E
2041-2053 2055-205E 2190-23FF 2500-2775 2794-2BFF 2E00-2E7F 3001-3003 3008-3020 3030
"""
OPERATOR_MORE = "3021-302F 300-36F 1DC0-1DFF 20D0-20FF FE00-FE0F FE20-FE2F E0100-E01EF"
# What may not stand in a name between backticks: backtick, backslash, controls, DEL, white space but for the space.
NOT_RAW_ASCII = "`\\"
NOT_RAW = "0-1F 7F 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"
RAW_BLANK = "200E-200F"  # and the space


def ranges(text: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in text.split())


PLANES = " ".join(f"{p:X}0000-{p:X}FFFD" for p in range(1, 15))
HEAD = f"[{IDENTIFIER_ASCII}{ranges(IDENTIFIER_HEAD + PLANES)}]"
MORE = f"[{IDENTIFIER_ASCII}{DIGITS}{ranges(IDENTIFIER_HEAD + IDENTIFIER_MORE + ' ' + PLANES)}]"
OP_ASCII = regex.escape(OPERATOR_ASCII, special_only=False)
OP_HEAD, OP_MORE = f"[{OP_ASCII}{ranges(OPERATOR_HEAD)}]", f"[{OP_ASCII}{ranges(OPERATOR_HEAD + OPERATOR_MORE)}]"
#: = ! ? & are operators only together with others; ! and ? never belong to one that begins with a full stop.
_BODY = f"(?:(?![=!?&]){OP_HEAD}{OP_MORE}*|[=!?&]{OP_MORE}+)"

PATTERNS = {
    "identifier": f"{HEAD}{MORE}*",
    "operatorToken": _BODY,
    "operatorName": _BODY,
    "postfixOperatorToken": f"(?![!?]){_BODY}",
    "dotOperator": rf"\.(?:(?![!?])(?:\.|{OP_MORE}))+",
    "poundName": f"#{HEAD}{MORE}*",
    "propertyWrapperProjection": rf"\$[0-9]*(?![0-9]){MORE}{MORE}*",
    "escapedIdentifier": f"`(?!{OP_HEAD}{OP_MORE}*`)(?![ {ranges(RAW_BLANK)}]+`)[^{regex.escape(NOT_RAW_ASCII)}{ranges(NOT_RAW)}]+`",
}


def portable(source: str) -> str:
    """A pattern in the notation of the regex module: \\u{...} as \\U........"""
    return regex.sub(r"(\\\\)|\\u\{([0-9A-Fa-f]+)\}", lambda m: m[1] or f"\\U{int(m[2], 16):08X}", source)
