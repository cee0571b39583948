"""Class names that selectors may use, and the semantic names they stand for.

A class resolves in two steps: a short name to one of the taxonomy's names, and
that to the ``semantic_name`` of nodes. A whole category (``.flow``, ``.operator``)
stands for all names that begin with it.
"""

from __future__ import annotations

from ..functions.predicates import UnknownClassError

#: Taxonomy name, its short names, and its semantic name (None: no node has it, with what to use instead).
_TABLE = """
def-func        DEFINITION_FUNCTION     method func def function fn
def-class       DEFINITION_CLASS        struct trait class enum union interface cls
def-var         DEFINITION_VARIABLE     let var const param arg variable constant parameter argument
def-module      DEFINITION_MODULE       package module ns namespace
flow-cond       FLOW_CONDITIONAL        switch match if cond conditional
flow-loop       FLOW_LOOP               foreach loop while for
flow-jump       FLOW_JUMP               await yield return ret continue break jump
error-try       ERROR_TRY               try
error-catch     ERROR_CATCH             rescue except catch
error-throw     ERROR_THROW             raise throw assert
error-finally   ERROR_FINALLY           defer ensure finally
literal-str     LITERAL_STRING          string str
literal-num     LITERAL_NUMBER          float int num number
literal-atom    LITERAL_ATOMIC          nil null none bool boolean
literal-bool    LITERAL_ATOMIC
literal-coll    LITERAL_STRUCTURED      set map tuple array dict list coll
name-id         NAME_IDENTIFIER         name ident id identifier
access-call     COMPUTATION_CALL        invoke call
access-member   COMPUTATION_ACCESS      attribute property prop field attr member
access-index    COMPUTATION_ACCESS      subscript index
statement-assign OPERATOR_ASSIGNMENT    assignment assign
statement-delete EXECUTION_MUTATION     del delete
block-body      ORGANIZATION_BLOCK      body block
metadata-comment METADATA_COMMENT       comment
metadata-annotation METADATA_ANNOTATION annotation dec decorator
external-import EXTERNAL_IMPORT         use require import
external-include EXTERNAL_IMPORT        include
external-export EXTERNAL_EXPORT         pub export
external-extern EXTERNAL_FOREIGN        ffi extern
operator-arith  OPERATOR_ARITHMETIC     arithmetic math arith
operator-cmp    OPERATOR_COMPARISON     compare comparison cmp
operator-logic  OPERATOR_LOGICAL        logical logic
typedef-generic TYPE_GENERIC            template generic
transform-comp  TRANSFORM_QUERY         comprehension comp
pattern-destructure PATTERN_DESTRUCTURE unpack destructure
pattern-rest    PATTERN_COLLECT         splat spread rest
operator        OPERATOR_               op
typedef         TYPE_                   type
transform       TRANSFORM_              xform
pattern         PATTERN_                pat
syntax          PARSER_                 syn
definition      DEFINITION_
literal         LITERAL_                lit value
flow            FLOW_                   control
error           ERROR_                  err
external        EXTERNAL_               ext
computation     COMPUTATION_
access          COMPUTATION_
statement       EXECUTION_              stmt
metadata        METADATA_
organization    ORGANIZATION_
execution       EXECUTION_
names           NAME_
"""
_NOWHERE = {
    "flow-guard": ("guard", "match [type=guard_statement]; .assert is an error-throw"),
    "name-self": ("self this", "match #self or #this"),
    "name-super": ("super base", "match #super"),
    "metadata-doc": ("doc docstring", "match the first string in a definition: .fn .str:first"),
    "access-new": ("new constructor", "match .call#Name"),
    "operator-bits": ("bits bitwise", "match [type=binary_operator] or .operator"),
    "typedef-union": ("", "match .union, which is a class"),
    "typedef-special": ("void any never", "match by [type=...]"),
    "transform-gen": ("gen generator", "match .comp or [type=generator_expression]"),
    "block-ns": ("", "match .module"),
}
EXACT = frozenset(
    f"{family}_{member}"
    for family, members in {
        "PARSER": "CONSTRUCT DELIMITER PUNCTUATION SYNTAX",
        "METADATA": "COMMENT ANNOTATION DIRECTIVE DEBUG",
        "EXTERNAL": "IMPORT EXPORT FOREIGN EMBED",
        "LITERAL": "NUMBER STRING ATOMIC STRUCTURED",
        "NAME": "IDENTIFIER QUALIFIED SCOPED ATTRIBUTE",
        "PATTERN": "DESTRUCTURE COLLECT TEMPLATE MATCH",
        "TYPE": "PRIMITIVE COMPOSITE REFERENCE GENERIC",
        "OPERATOR": "ARITHMETIC LOGICAL COMPARISON ASSIGNMENT",
        "COMPUTATION": "CALL ACCESS EXPRESSION CLOSURE",
        "TRANSFORM": "QUERY ITERATION PROJECTION AGGREGATION",
        "DEFINITION": "FUNCTION VARIABLE CLASS MODULE",
        "EXECUTION": "STATEMENT DECLARATION STATEMENT_CALL MUTATION",
        "FLOW": "CONDITIONAL LOOP JUMP SYNC",
        "ERROR": "TRY CATCH THROW FINALLY",
        "ORGANIZATION": "BLOCK LIST SECTION CONTAINER",
    }.items()
    for member in members.split()
)
#: The number of each semantic name, for ``semantic_type``; identifiers are 80.
NUMBERS = {n: 80 if n == "NAME_IDENTIFIER" else k + (k >= 80) for k, n in enumerate(sorted(EXACT - {"NAME_IDENTIFIER"}) + ["NAME_IDENTIFIER"])}

_ROWS = [line.split() for line in _TABLE.strip().splitlines()]
SEMANTIC = {row[0]: row[1] for row in _ROWS}
SHORT = {s: row[0] for row in _ROWS for s in row[2:]} | {s: name for name, (shorts, _) in _NOWHERE.items() for s in shorts.split()}


def resolve_alias(token: str) -> str:
    """The taxonomy form of a selector token such as ``.fn#main``; others as they are."""
    if not token.startswith("."):
        return token
    end = next((k for k, c in enumerate(token) if k and not (c.isalnum() or c in "_-")), len(token))
    return "." + SHORT.get(token[1:end], token[1:end]) + token[end:]


def resolve_aliases(selector: str) -> str:
    """A whole selector with the classes in their taxonomy form; what stands in quotes stays."""
    out, at, quote = [], 0, ""
    while at < len(selector):
        c = selector[at]
        if quote:
            step = 2 if c == "\\" else 1
            quote = "" if c == quote else quote
            out.append(selector[at : at + step])
            at += step
        elif c == "." and (at + 1 < len(selector)) and (selector[at + 1].isalpha() or selector[at + 1] == "_"):
            end = at + 1
            while end < len(selector) and (selector[end].isalnum() or selector[end] in "_-"):
                end += 1
            out.append(resolve_alias(selector[at:end]))
            at = end
        else:
            quote = c if c in "'\"" else ""
            out.append(c)
            at += 1
    return "".join(out)


def semantic_name(cls: str) -> str:
    """The semantic name that a class stands for; one that ends in ``_`` is a category."""
    name = SHORT.get(cls, cls)
    if name in _NOWHERE:
        raise UnknownClassError(f".{cls}: no node has this class; {_NOWHERE[name][1]}")
    if name in SEMANTIC:
        return SEMANTIC[name]
    if cls.upper() in EXACT:
        return cls.upper()
    lowered = cls.lower()
    if lowered != cls and (lowered in SHORT or lowered in SEMANTIC):
        return semantic_name(lowered)
    raise UnknownClassError(f".{cls} is no class that selectors know")
