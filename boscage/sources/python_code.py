"""Trees of Python source: the standard parser's tree, with blocks, parameters and identifiers as nodes of their own."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from pyspark.sql import DataFrame

from ..schema import DEFINITION, REFERENCE, SCOPED
from .trees import Node, parsed

#: Type name and semantic name of the parser's classes.
_KINDS = {
    "Return": ("return_statement", "FLOW_JUMP"), "Break": ("break_statement", "FLOW_JUMP"), "Continue": ("continue_statement", "FLOW_JUMP"), "Yield": ("yield", "FLOW_JUMP"), "YieldFrom": ("yield", "FLOW_JUMP"), "Await": ("await", "FLOW_JUMP"),
    "If": ("if_statement", "FLOW_CONDITIONAL"), "IfExp": ("conditional_expression", "FLOW_CONDITIONAL"), "Match": ("match_statement", "FLOW_CONDITIONAL"), "For": ("for_statement", "FLOW_LOOP"), "AsyncFor": ("for_statement", "FLOW_LOOP"), "While": ("while_statement", "FLOW_LOOP"),
    "Try": ("try_statement", "ERROR_TRY"), "TryStar": ("try_statement", "ERROR_TRY"), "ExceptHandler": ("except_clause", "ERROR_CATCH"), "Raise": ("raise_statement", "ERROR_THROW"), "Assert": ("assert_statement", "ERROR_THROW"),
    "With": ("with_statement", "ORGANIZATION_CONTAINER"), "AsyncWith": ("with_statement", "ORGANIZATION_CONTAINER"), "withitem": ("with_item", "ORGANIZATION_CONTAINER"), "Delete": ("delete_statement", "EXECUTION_MUTATION"),
    "Assign": ("assignment", "OPERATOR_ASSIGNMENT"), "AugAssign": ("augmented_assignment", "OPERATOR_ASSIGNMENT"), "AnnAssign": ("assignment", "OPERATOR_ASSIGNMENT"), "NamedExpr": ("named_expression", "OPERATOR_ASSIGNMENT"),
    "BinOp": ("binary_operator", "OPERATOR_ARITHMETIC"), "UnaryOp": ("unary_operator", "OPERATOR_ARITHMETIC"), "BoolOp": ("boolean_operator", "OPERATOR_LOGICAL"), "Compare": ("comparison_operator", "OPERATOR_COMPARISON"),
    "List": ("list", "LITERAL_STRUCTURED"), "Dict": ("dictionary", "LITERAL_STRUCTURED"), "Set": ("set", "LITERAL_STRUCTURED"), "Tuple": ("tuple", "LITERAL_STRUCTURED"), "JoinedStr": ("string", "LITERAL_STRING"),
    "ListComp": ("list_comprehension", "TRANSFORM_QUERY"), "SetComp": ("set_comprehension", "TRANSFORM_QUERY"), "DictComp": ("dictionary_comprehension", "TRANSFORM_QUERY"), "GeneratorExp": ("generator_expression", "TRANSFORM_QUERY"), "comprehension": ("for_in_clause", "TRANSFORM_ITERATION"),
    "Attribute": ("attribute", "COMPUTATION_ACCESS"), "Subscript": ("subscript", "COMPUTATION_ACCESS"), "Slice": ("slice", "COMPUTATION_ACCESS"), "Lambda": ("lambda", "COMPUTATION_CLOSURE"), "Starred": ("list_splat", "PATTERN_COLLECT"),
    "Global": ("global_statement", "EXECUTION_DECLARATION"), "Nonlocal": ("nonlocal_statement", "EXECUTION_DECLARATION"), "Pass": ("pass_statement", "EXECUTION_STATEMENT"), "Expr": ("expression_statement", "EXECUTION_STATEMENT"), "keyword": ("keyword_argument", "OPERATOR_ASSIGNMENT"), "match_case": ("case_clause", "FLOW_CONDITIONAL"), "FormattedValue": ("interpolation", "LITERAL_STRING"),
}
_BODIES = ("body", "orelse", "finalbody", "handlers", "cases")
_SKIPPED = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop, ast.type_ignore)
#: Strings and comments of a text that has no formatted strings, whose quotes may nest.
_COMMENT = re.compile(r"""#[^\n]*|[rR]?(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""", re.S)
_FORMATTED = re.compile(r"""[fFtT][rR]?["']""")


def _written(n: ast.AST) -> str:
    """An expression's source; for names with dots, which most decorators are, without the unparser."""
    names, inner = [], n
    while type(inner) is ast.Attribute:
        names.append(inner.attr)
        inner = inner.value
    return ".".join([inner.id, *reversed(names)]) if type(inner) is ast.Name else ast.unparse(n)


def _comments(text: str) -> list[tuple[int, str]]:
    """Line and text of each comment of a file that the parser takes."""
    if "#" not in text:
        return []
    if _FORMATTED.search(text) or "\r" in text or "\f" in text:
        found = []
        try:
            found += [(t.start[0], t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
        except (tokenize.TokenError, IndentationError, SyntaxError):
            pass
        return found
    out, line, at = [], 1, 0
    for m in _COMMENT.finditer(text):
        if m[0][0] == "#":
            line += text.count("\n", at, m.start())
            at = m.start()
            out.append((line, m[0]))
    return out


class _Builder:
    def __init__(self, text: str):
        self.lines = text.splitlines() or [""]
        self.ascii = text.isascii()

    def peek(self, line: int, column: int = 0) -> str:
        whole = self.lines[min(line, len(self.lines)) - 1]
        if self.ascii:
            return whole[column:].strip()
        return whole.encode()[column:].decode("utf-8", "replace").strip()

    def span(self, n: ast.AST, outer: Node) -> tuple[int, int]:
        return getattr(n, "lineno", outer.start), getattr(n, "end_lineno", None) or outer.end

    def identifier(self, name: str, line: int, flags: int) -> Node:
        return Node("identifier", "NAME_IDENTIFIER", line, line, name, flags, name)

    def block(self, body: list[ast.AST], outer: Node) -> Node | None:
        if not body:
            return None
        start, end = min(self._first(s) for s in body), max(s.end_lineno for s in body)
        out = Node("block", "ORGANIZATION_BLOCK", start, end, peek=self.peek(start))
        return out.add(*[self.node(s, out) for s in body])

    @staticmethod
    def _first(n: ast.AST) -> int:
        return min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", ()))])

    def parameter(self, a: ast.arg, default: ast.AST | None, outer: Node) -> Node:
        kind = {(False, False): "identifier", (True, False): "typed_parameter", (False, True): "default_parameter", (True, True): "typed_default_parameter"}[a.annotation is not None, default is not None]
        out = Node(kind, "DEFINITION_VARIABLE", a.lineno, a.end_lineno, a.arg, DEFINITION, a.arg)
        return out.add(*[self.node(x, outer) for x in (a.annotation, default) if x is not None])

    def parameters(self, n: ast.arguments, outer: Node) -> tuple[Node, list[dict]]:
        plain = [*n.posonlyargs, *n.args]
        defaults = dict(zip(reversed(plain), reversed(n.defaults))) | {a: d for a, d in zip(n.kwonlyargs, n.kw_defaults) if d}
        every = [*plain, *filter(None, [n.vararg]), *n.kwonlyargs, *filter(None, [n.kwarg])]
        out = Node("parameters", "ORGANIZATION_LIST", outer.start, outer.start, peek="parameters")
        listed = [{"name": ("**" if a is n.kwarg else "*" if a is n.vararg else "") + a.arg, "type": ast.unparse(a.annotation) if a.annotation else None} for a in every]
        return out.add(*[self.parameter(a, defaults.get(a), out) for a in every]), listed

    def definition(self, n, outer: Node) -> Node:
        function = not isinstance(n, ast.ClassDef)
        out = Node("function_definition" if function else "class_definition", "DEFINITION_FUNCTION" if function else "DEFINITION_CLASS", n.lineno, n.end_lineno, n.name, DEFINITION | SCOPED, self.peek(n.lineno, n.col_offset))
        for d in n.decorator_list:
            said = _written(d)
            out.modifiers.append("@" + said)
            out.add(Node("decorator", "METADATA_ANNOTATION", d.lineno, d.end_lineno, said.split("(")[0], REFERENCE, "@" + said).add(self.node(d, out)))
        out.add(self.identifier(n.name, n.lineno, 0))
        if function:
            listing, out.parameters = self.parameters(n.args, out)
            out.signature = ast.unparse(n.returns) if n.returns else None
            out.add(listing, self.node(n.returns, out) if n.returns else None)
        else:
            out.add(*[self.node(b, out) for b in [*n.bases, *n.keywords]])
        return out.add(self.block(n.body, out))

    def imports(self, n, outer: Node) -> Node:
        plain = isinstance(n, ast.Import)
        first = n.names[0].name if plain else n.module or "."
        out = Node("import_statement" if plain else "import_from_statement", "EXTERNAL_IMPORT", n.lineno, n.end_lineno, first, DEFINITION, self.peek(n.lineno, n.col_offset))
        if not plain and n.module:
            out.add(self.identifier(n.module, n.lineno, 0))
        for a in n.names:
            out.add(self.identifier(a.asname or a.name.split(".")[0], n.lineno, DEFINITION))
        return out

    def node(self, n: ast.AST, outer: Node) -> Node | None:
        if type(n) is ast.Name:
            return self.identifier(n.id, n.lineno, REFERENCE if isinstance(n.ctx, ast.Load) else DEFINITION)
        if n is None or isinstance(n, _SKIPPED):
            return None
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return self.definition(n, outer)
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            return self.imports(n, outer)
        start, end = self.span(n, outer)
        peek = self.peek(start, n.col_offset) if hasattr(n, "col_offset") else None
        if isinstance(n, ast.Constant):
            v = n.value
            kind = ("string", "LITERAL_STRING") if isinstance(v, (str, bytes)) else (str(v).lower(), "LITERAL_ATOMIC") if v is None or isinstance(v, bool) else ("ellipsis", "LITERAL_ATOMIC") if v is ... else ("float" if isinstance(v, (float, complex)) else "integer", "LITERAL_NUMBER")
            return Node(*kind, start, end, peek=peek)
        if isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            out = Node("call", "COMPUTATION_CALL", start, end, name, REFERENCE, peek)
            args = Node("argument_list", "ORGANIZATION_LIST", start, end)
            return out.add(self.node(f, out), args.add(*[self.node(a, args) for a in [*n.args, *n.keywords]]))
        if isinstance(n, ast.arguments):
            return self.parameters(n, outer)[0]
        kind, semantic = _KINDS.get(type(n).__name__, (type(n).__name__.lower(), "COMPUTATION_EXPRESSION"))
        out = Node(kind, semantic, start, end, peek=peek)
        if isinstance(n, ast.Attribute):
            out.name, out.flags = n.attr, REFERENCE if isinstance(n.ctx, ast.Load) else DEFINITION
            return out.add(self.node(n.value, out), self.identifier(n.attr, end, 0))
        if isinstance(n, ast.ExceptHandler) and n.name:
            out.add(self.node(n.type, out), self.identifier(n.name, start, DEFINITION))
            return out.add(self.block(n.body, out))
        if isinstance(n, (ast.Global, ast.Nonlocal)):
            return out.add(*[self.identifier(x, start, REFERENCE) for x in n.names])
        if isinstance(n, ast.keyword):
            out.name = n.arg
        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target
            out.name = target.id if isinstance(target, ast.Name) else None
            out.flags = DEFINITION if out.name else 0
        for field in n._fields:
            value = getattr(n, field, None)
            if field in _BODIES and isinstance(value, list):
                if field in ("handlers", "cases"):
                    out.add(*[self.node(v, out) for v in value])
                else:
                    out.add(self.block(value, out))
            else:
                for v in value if isinstance(value, list) else [value]:
                    if isinstance(v, ast.AST):
                        out.add(self.node(v, out))
        return out


def parse(text: str, path: str) -> Node:
    """The tree of a file. One that can't be parsed is a module with an ERROR node, whose peek says why."""
    last = max(1, len(text.splitlines()))
    root = Node("module", "DEFINITION_MODULE", 1, last, path.rsplit("/", 1)[-1].removesuffix(".py"), DEFINITION | SCOPED, text.lstrip().split("\n", 1)[0])
    try:
        tree = ast.parse(text)
        builder = _Builder(text)
        found = [builder.node(n, root) for n in tree.body]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = min(getattr(e, "lineno", None) or 1, last)
        return root.add(Node("ERROR", "PARSER_CONSTRUCT", line, line, peek=str(e)))
    comments = [Node("comment", "METADATA_COMMENT", line, line, peek=said) for line, said in _comments(text)]
    return root.add(*sorted([*found, *comments], key=lambda n: (n.start, n.type == "comment")))


def errors(text: str) -> int:
    """How many ERROR nodes a text has."""
    return sum(n.type == "ERROR" for n in parse(text, "").children)


def nodes_from_files(files: DataFrame) -> DataFrame:
    return parsed(files, parse, "python")
