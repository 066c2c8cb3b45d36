"""Kinds of tokens and nodes, keywords, operators and tags. Names and numbers are part of the contract."""

from __future__ import annotations

# Token kinds (below 256) and node kinds of the syntax tree.
_KINDS = """
TOMBSTONE 0 EOF 1 ERROR_TOKEN 2 MISSING_TOKEN 3
WHITESPACE 10 NEWLINE 11 COMMENT 12 ROXYGEN_COMMENT 13
IDENTIFIER 20 DOT_DOT_I 21 ELLIPSIS 22 INTEGER 23 DOUBLE 24 COMPLEX 25 STRING 26 RAW_STRING 27
NULL_KW 40 NA_KW 41 TRUE_KW 42 FALSE_KW 43 INF_KW 44 NAN_KW 45 NA_INTEGER_KW 46 NA_REAL_KW 47 NA_COMPLEX_KW 48 NA_CHARACTER_KW 49
FUNCTION_KW 50 IF_KW 51 ELSE_KW 52 FOR_KW 53 IN_KW 54 WHILE_KW 55 REPEAT_KW 56 NEXT_KW 57 BREAK_KW 58
L_PAREN 70 R_PAREN 71 L_BRACE 72 R_BRACE 73 L_BRACKET 74 R_BRACKET 75 L_DBRACKET 76 R_DBRACKET 77 COMMA 78 SEMICOLON 79
PLUS 90 MINUS 91 STAR 92 SLASH 93 CARET 94 COLON 95 TILDE 96 QUESTION 97 BANG 98 AMP 99 AMP2 100 PIPE 101 PIPE2 102
LT 103 LE 104 GT 105 GE 106 EQ2 107 NE 108 EQ 109 LEFT_ASSIGN 110 SUPER_LEFT_ASSIGN 111 RIGHT_ASSIGN 112 SUPER_RIGHT_ASSIGN 113
WALRUS 114 NS_GET 115 NS_GET_INTERNAL 116 DOLLAR 117 AT 118 SPECIAL 119 PIPE_BIND 120 BACKSLASH 121 UNDERSCORE 122 NATIVE_PIPE 123
SOURCE_FILE 256 ERROR 257 MISSING 258 EXPRESSION_LIST 259 IDENTIFIER_EXPR 260 LITERAL_EXPR 261 PAREN_EXPR 262 BRACED_EXPR 263
UNARY_EXPR 264 BINARY_EXPR 265 ASSIGNMENT_EXPR 266 CALL_EXPR 267 ARGUMENT_LIST 268 ARGUMENT 269 FUNCTION_EXPR 270 PARAMETER_LIST 271
PARAMETER 272 IF_EXPR 273 WHILE_EXPR 274 FOR_EXPR 275 REPEAT_EXPR 276 NEXT_EXPR 277 BREAK_EXPR 278 SUBSET_EXPR 279 SUBSET2_EXPR 280
MEMBER_EXPR 281 NAMESPACE_EXPR 282 FORMULA_EXPR 283 HELP_EXPR 284 PIPE_EXPR 285 INDEX_ARGUMENT_LIST 286 CONDITION 287 ELSE_CLAUSE 288
""".split()
ID = {name: int(n) for name, n in zip(_KINDS[::2], _KINDS[1::2])}

# Reserved words.
KEYWORDS = {
    "NULL": "NULL_KW", "NA": "NA_KW", "TRUE": "TRUE_KW", "FALSE": "FALSE_KW", "Inf": "INF_KW", "NaN": "NAN_KW",
    "NA_integer_": "NA_INTEGER_KW", "NA_real_": "NA_REAL_KW", "NA_complex_": "NA_COMPLEX_KW", "NA_character_": "NA_CHARACTER_KW",
    "function": "FUNCTION_KW", "if": "IF_KW", "else": "ELSE_KW", "for": "FOR_KW", "in": "IN_KW", "while": "WHILE_KW",
    "repeat": "REPEAT_KW", "next": "NEXT_KW", "break": "BREAK_KW",
}

# Spellings of operators and delimiters.
OPERATORS = {
    "<<-": "SUPER_LEFT_ASSIGN", "->>": "SUPER_RIGHT_ASSIGN", ":::": "NS_GET_INTERNAL", "[[": "L_DBRACKET", "**": "CARET", "<=": "LE",
    ">=": "GE", "==": "EQ2", "!=": "NE", "<-": "LEFT_ASSIGN", "->": "RIGHT_ASSIGN", ":=": "WALRUS", "::": "NS_GET", "&&": "AMP2",
    "||": "PIPE2", "|>": "NATIVE_PIPE", "=>": "PIPE_BIND", "(": "L_PAREN", ")": "R_PAREN", "{": "L_BRACE", "}": "R_BRACE",
    "[": "L_BRACKET", "]": "R_BRACKET", ",": "COMMA", ";": "SEMICOLON", "+": "PLUS", "-": "MINUS", "*": "STAR", "/": "SLASH",
    "^": "CARET", ":": "COLON", "~": "TILDE", "?": "QUESTION", "!": "BANG", "&": "AMP", "|": "PIPE", "<": "LT", ">": "GT", "=": "EQ",
    "$": "DOLLAR", "@": "AT", "\\": "BACKSLASH", "_": "UNDERSCORE",
}

TRIVIA = frozenset({"WHITESPACE", "NEWLINE", "COMMENT", "ROXYGEN_COMMENT"})
NAMES = frozenset({"IDENTIFIER", "DOT_DOT_I"})
NAMES_OR_STRINGS = NAMES | {"STRING", "RAW_STRING"}
TAGS = NAMES_OR_STRINGS | {"NULL_KW"}
LITERALS = frozenset({"INTEGER", "DOUBLE", "COMPLEX", "STRING", "RAW_STRING", *list(KEYWORDS.values())[:10]})

# Kinds of expressions that a typed view casts to.
EXPRESSIONS = frozenset(k for k in ID if k.endswith("_EXPR")) | {"ERROR", "MISSING"}

# Kinds of the documentation sidecar.
_SIDECAR = """
LINE_PREFIX 1 WHITESPACE 2 NEWLINE 3 TAG_MARK 4 TAG_NAME 5 TEXT 6 IDENTIFIER 7 COMMA 8 COLON 9 L_PAREN 10 R_PAREN 11 L_BRACKET 12
R_BRACKET 13 CODE_SPAN 14 CODE_BLOCK 15 ERROR_TOKEN 16 MISSING 17
SIDECAR 256 ROXYGEN_BLOCK 257 ROXYGEN_LINE 258 TAG 259 TAG_BODY 260 PARAM_BODY 261 NAME_LIST 262 SECTION_BODY 263 CODE_BODY 264
GENERIC_BODY 265 DESCRIPTION 266 INLINE 267 LINK 268 PUNCTUATION 269 ERROR 270 OPAQUE_BODY 271
""".split()
SIDECAR_ID = {name: int(n) for name, n in zip(_SIDECAR[::2], _SIDECAR[1::2])}

# Documentation tags by the form of their body.
PARAMETER, SECTION, CODE, GENERIC = "Parameter", "Section", "Code", "Generic"
REGISTRY = (
    {"param": PARAMETER, "section": SECTION}
    | dict.fromkeys("eval example examples examplesIf".split(), CODE)
    | dict.fromkeys(
        """aliases author backref concept describeIn description details docType evalRd export exportClass exportMethod exportPattern
        exportS3Method family field format import importClassesFrom importFrom importMethodsFrom include includeRmd inherit
        inheritDotParams inheritParams inheritSection keywords md method name noMd noRd note order rawNamespace rawRd rdname references
        return returns seealso slot source template templateVar title usage useDynLib""".split(),
        GENERIC,
    )
)


def extended(registry: dict[str, str], more: dict[str, str]) -> dict[str, str]:
    """A registry with some tags added or replaced; the given one stays as it is."""
    return {k: v for k, v in registry.items() if k not in more} | more
