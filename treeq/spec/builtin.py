"""Built-in languages whose parser Python has: Python by ``ast``, YAML by PyYAML.

Their trees have the shape that the language's users know from its kinds and fields;
what differs: tokens such as brackets and keywords are no nodes, several children in
one place are a ``List`` in the field, and a text with errors has no partial tree.
"""

from __future__ import annotations

import ast
import re
import tokenize
from bisect import bisect_left, bisect_right
from functools import lru_cache

from treeq.errors import ConfigError
from treeq.spec.parse import Report, Shape, Tree
from treeq.syntax import Kind, Syntax

# Kinds by the name of Python's own node.
PYTHON = {
    "FunctionDef": "FunctionDefinition", "AsyncFunctionDef": "FunctionDefinition", "ClassDef": "ClassDefinition", "Expr": "ExpressionStatement", "BinOp": "BinaryOperator",
    "BoolOp": "BooleanOperator", "UnaryOp": "UnaryOperator", "Compare": "ComparisonOperator", "Name": "Identifier", "Assign": "Assignment", "AnnAssign": "Assignment",
    "AugAssign": "AugmentedAssignment", "Return": "ReturnStatement", "Delete": "DeleteStatement", "If": "IfStatement", "For": "ForStatement", "AsyncFor": "ForStatement",
    "While": "WhileStatement", "With": "WithStatement", "AsyncWith": "WithStatement", "Raise": "RaiseStatement", "Try": "TryStatement", "TryStar": "TryStatement",
    "Assert": "AssertStatement", "Import": "ImportStatement", "ImportFrom": "ImportFromStatement", "Global": "GlobalStatement", "Nonlocal": "NonlocalStatement",
    "Pass": "PassStatement", "Break": "BreakStatement", "Continue": "ContinueStatement", "IfExp": "ConditionalExpression", "Dict": "Dictionary", "List": "ListDisplay",
    "ListComp": "ListComprehension", "SetComp": "SetComprehension", "DictComp": "DictionaryComprehension", "GeneratorExp": "GeneratorExpression", "JoinedStr": "String",
    "arguments": "Parameters", "arg": "Parameter", "keyword": "KeywordArgument", "ExceptHandler": "ExceptClause", "withitem": "WithItem", "comprehension": "ForInClause",
    "alias": "AliasedImport", "Mult": "Multiply", "Sub": "Subtract", "Div": "Divide",
}
# Operators by the name of Python's own node.
OPERATORS = {
    "Add": "+", "Sub": "-", "Mult": "*", "MatMult": "@", "Div": "/", "Mod": "%", "Pow": "**", "LShift": "<<", "RShift": ">>", "BitOr": "|", "BitXor": "^", "BitAnd": "&",
    "FloorDiv": "//", "And": "and", "Or": "or", "Not": "not", "Invert": "~", "UAdd": "+", "USub": "-", "Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=",
    "Is": "is", "IsNot": "is not", "In": "in", "NotIn": "not in",
}
# Fields by the name of Python's own.
FIELDS = {"op": "operator", "func": "function", "attr": "attribute", "test": "condition", "orelse": "alternative", "operand": "argument"}
CONSTANTS = {int: "Integer", float: "Float", complex: "Float", str: "String", bytes: "String", bool: "Boolean", type(None): "None", type(...): "Ellipsis"}
#: Lines end where Python ends them: not at form feeds or the separators of Unicode.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_NAMED = re.compile(r"(?:async\s+)?(?:def|class)\s+(\w+)")


class Plain:
    """A scanner for languages whose trees hold all that they pass over."""

    @staticmethod
    def passed(text: str, at: int) -> tuple[int, bool]:
        return at, False


class Builtin:
    """A language by name: its syntax and what makes trees of texts."""

    def __init__(self, syntax: Syntax, make):
        self.syntax, self.make, self.scanner = syntax, make, Plain

    def parse(self, text: str) -> tuple[Tree | None, list[Report]]:
        return self.make(text)

    def read(self, text: str) -> tuple[Shape | None, list[int], list[Report]]:
        """The tree as a shape of its own, with the places where nodes start and those where they end."""
        tree, wrong = self.make(text)
        if tree is None:
            return None, [], wrong
        shape = Shape(tree)
        places, n = shape.start + shape.end, len(shape.kind)
        shape.start, shape.end = range(n), range(n, 2 * n)
        shape.trail = shape.end
        return shape, places, wrong


def kind_of(name: str) -> str:
    return PYTHON.get(name, name)


def field_of(node: type, name: str) -> str:
    return "parameters" if name == "args" and node in (ast.FunctionDef, ast.AsyncFunctionDef) else FIELDS.get(name, name)


def python_syntax() -> Syntax:
    kinds: dict[str, set[str]] = {}
    for name in dir(ast):
        node = getattr(ast, name)
        if isinstance(node, type) and issubclass(node, ast.AST):
            kinds.setdefault(kind_of(name), set()).update(field_of(node, f) for f in node._fields)
    for name in ("FunctionDefinition", "ClassDefinition"):
        kinds[name].add("name")
    kinds |= {name: set() for name in CONSTANTS.values() if name not in kinds}
    kinds.setdefault("Identifier", set())
    return Syntax({k: Kind(k, None, tuple(sorted(fields))) for k, fields in kinds.items() if k != "List"})


class PythonTree:
    def __init__(self, text: str):
        self.text = text
        self.lines = _LINE.findall(text)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))
        self.comments: list[tuple[int, str]] = []
        self.signs: dict[str, list[int]] = {}
        ends = iter([line.rstrip("\r\n") + "\n" for line in self.lines])
        try:
            for token in tokenize.generate_tokens(lambda: next(ends, "")):
                if token.type in (tokenize.COMMENT, tokenize.OP):
                    at = self.starts[token.start[0] - 1] + token.start[1]
                    if token.type == tokenize.COMMENT:
                        self.comments.append((at, token.string))
                    else:
                        self.signs.setdefault(token.string, []).append(at)
        except (tokenize.TokenError, SyntaxError):
            pass  # the parser reads it all the same; later comments stay unknown

    def place(self, line: int, column: int) -> int:
        """The character at a line and a column in bytes."""
        if line > len(self.lines):
            return len(self.text)
        own = self.lines[line - 1]
        return self.starts[line - 1] + (column if own.isascii() else len(own.encode()[:column].decode(errors="ignore")))

    def span(self, node: ast.AST) -> tuple[int, int] | None:
        if getattr(node, "end_lineno", None) is None:
            return None
        return self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset)

    def tree(self, root: ast.AST) -> Tree:
        """In post-order with a stack of our own, as texts may nest deeply."""
        done: dict[int, Tree | None] = {}
        todo: list[tuple[ast.AST, bool]] = [(root, False)]
        while todo:
            node, ready = todo.pop()
            if ready:
                done[id(node)] = self.made(node, done)
            else:
                todo.append((node, True))
                todo.extend((c, False) for c in ast.iter_child_nodes(node))
        return done[id(root)]

    def made(self, node: ast.AST, done: dict) -> Tree | None:
        name = type(node).__name__
        span = self.span(node)
        if isinstance(node, ast.Constant):
            return Tree(CONSTANTS.get(type(node.value), "Constant"), None, *span, [])
        if name in OPERATORS or isinstance(node, (ast.expr_context,)):
            return None  # their place follows from what is around them
        children: list[Tree] = []
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and (m := _NAMED.search(self.text, span[0], span[1])):
            children.append(Tree("Identifier", "name", m.start(1), m.end(1), []))
        for label, value in ast.iter_fields(node):
            label = field_of(type(node), label)
            own = [value] if isinstance(value, ast.AST) else value if isinstance(value, list) else []
            trees = [t for x in own if isinstance(x, ast.AST) and (t := done[id(x)])]
            if isinstance(value, list):
                if trees:
                    children.append(Tree("List", label, trees[0].start, trees[-1].end, trees))
            elif trees:
                trees[0].label = label
                children.append(trees[0])
        children.sort(key=lambda t: (t.start, -t.end))
        if isinstance(node, ast.Attribute):
            children.append(Tree("Identifier", "attribute", span[1] - len(node.attr), span[1], []))
        if isinstance(node, (ast.BinOp, ast.AugAssign)):
            self.operator(node, children)
        elif isinstance(node, ast.UnaryOp):
            sign = OPERATORS[type(node.op).__name__]
            children.insert(0, Tree(kind_of(type(node.op).__name__), "operator", span[0], span[0] + len(sign), []))
        if span is None:
            if not children and not isinstance(node, ast.Module):
                return None
            span = (children[0].start, children[-1].end) if children else (0, 0)
        return Tree(kind_of(name), None, *span, children)

    def operator(self, node: ast.BinOp | ast.AugAssign, children: list[Tree]) -> None:
        """The operator behind the first child, by the tokens."""
        name = type(node.op).__name__
        sign = OPERATORS[name]
        places = self.signs.get(sign + "=" if isinstance(node, ast.AugAssign) else sign, [])
        i = bisect_left(places, children[0].end)
        at = places[i] if i < len(places) and places[i] < children[-1].start else self.text.find(sign, children[0].end)
        children.insert(1, Tree(kind_of(name), "operator", at, at + len(sign), []))


def python(text: str) -> tuple[Tree | None, list[Report]]:
    try:
        root = ast.parse(text)
    except (RecursionError, MemoryError):
        return None, [Report("unexpected_token", 0, "nested too deeply")]
    except (SyntaxError, ValueError) as e:
        line, column = getattr(e, "lineno", None) or 1, getattr(e, "offset", None) or 1
        starts = [0]
        for own in _LINE.findall(text):
            starts.append(starts[-1] + len(own))
        return None, [Report("unexpected_token", min(len(text), starts[min(line, len(starts)) - 1] + column - 1), str(getattr(e, "msg", e)))]
    made = PythonTree(text)
    tree = made.tree(root)
    begins = lambda c: c.start
    for at, note in made.comments:
        place = tree
        while True:
            # siblings begin in order; of those that overlap, as a dictionary's keys and values do, one before the last can hold it
            i = bisect_right(place.children, at, key=begins)
            inner = next((c for c in place.children[max(0, i - 2) : i][::-1] if at + len(note) <= c.end), None)
            if inner is None:
                break
            place = inner
        place.children.insert(bisect_left(place.children, at, key=begins), Tree("Comment", None, at, at + len(note), []))
    tree.start, tree.end = (0, len(text.rstrip())) if text.strip() else (0, 0)
    return tree, []


# Kinds of scalars by the tags of the YAML 1.1 types.
SCALARS = {"int": "IntegerScalar", "float": "FloatScalar", "bool": "BooleanScalar", "null": "NullScalar", "timestamp": "TimestampScalar"}
YAML = {
    "Stream": (), "Document": (), "BlockNode": (), "FlowNode": (), "BlockMapping": (), "FlowMapping": (), "BlockMappingPair": ("key", "value"), "FlowPair": ("key", "value"),
    "BlockSequence": (), "BlockSequenceItem": (), "FlowSequence": (), "PlainScalar": (), "StringScalar": (), "SingleQuoteScalar": (), "DoubleQuoteScalar": (), "BlockScalar": (), "Alias": (),
    **{k: () for k in SCALARS.values()},
}


@lru_cache(maxsize=None)
def yaml_loader():
    """The loader, made once."""
    import yaml as reader

    class Loader(reader.SafeLoader):
        def compose_node(self, parent, index):
            """An alias is a leaf of its own, so what it names isn't walked again, or without end."""
            if self.check_event(reader.AliasEvent) and self.peek_event().anchor in self.anchors:
                event = self.get_event()
                return reader.ScalarNode("alias", event.anchor, event.start_mark, event.end_mark)
            return super().compose_node(parent, index)

    return Loader


def yaml(text: str) -> tuple[Tree | None, list[Report]]:
    try:
        import yaml as reader
    except ImportError:
        raise ConfigError("YAML as a language needs PyYAML") from None

    try:
        roots = list(reader.compose_all(text, Loader=yaml_loader()))
    except RecursionError:
        return None, [Report("unexpected_token", 0, "nested too deeply")]
    except reader.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        return None, [Report("unexpected_token", mark.index if mark else 0, str(getattr(e, "problem", e)))]

    def value(n, label: str | None) -> Tree:
        flow = isinstance(n, reader.ScalarNode) and n.style not in ("|", ">") or getattr(n, "flow_style", False)
        start, end = n.start_mark.index, n.end_mark.index
        end = start + len(text[start:end].rstrip())
        if isinstance(n, reader.MappingNode):
            pair = "FlowPair" if flow else "BlockMappingPair"
            pairs = [[value(k, "key"), value(v, "value")] for k, v in n.value]
            inner = Tree("FlowMapping" if flow else "BlockMapping", None, start, end, [Tree(pair, None, p[0].start, max(p[0].end, p[1].end), p) for p in pairs])
        elif isinstance(n, reader.SequenceNode):
            items = [value(x, None) for x in n.value]
            inner = Tree("FlowSequence" if flow else "BlockSequence", None, start, end, items if flow else [Tree("BlockSequenceItem", None, x.start, x.end, [x]) for x in items])
        elif n.tag == "alias":
            inner = Tree("Alias", None, start, end, [])
        elif n.style in ("'", '"'):
            inner = Tree("SingleQuoteScalar" if n.style == "'" else "DoubleQuoteScalar", None, start, end, [])
        elif n.style in ("|", ">"):
            inner = Tree("BlockScalar", None, start, end, [])
        else:
            inner = Tree("PlainScalar", None, start, end, [Tree(SCALARS.get(n.tag.rsplit(":", 1)[-1], "StringScalar"), None, start, end, [])])
        return Tree("FlowNode" if flow else "BlockNode", label, start, end, [inner])

    try:
        documents = [Tree("Document", None, t.start, t.end, [t]) for t in (value(n, None) for n in roots if n is not None)]
    except RecursionError:
        return None, [Report("unexpected_token", 0, "nested too deeply")]
    return Tree("Stream", None, documents[0].start if documents else 0, documents[-1].end if documents else 0, documents), []


LANGUAGES = {
    "python": lambda: Builtin(python_syntax(), python),
    "yaml": lambda: Builtin(Syntax({k: Kind(k, None, fields) for k, fields in YAML.items()}), yaml),
}
