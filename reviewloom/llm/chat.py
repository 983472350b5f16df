"""Chat formatting by a compiler of a small template language.

A template is parsed to a tree, constants in it are folded, and the tree
becomes Python closures that render a conversation message by message. The
language has no calls, loops only over the messages, and sees nothing but
``message.role``, ``message.text``, ``loop.first`` and string constants, so it
can do no harm.

    {% for message in messages %} ... {% endfor %}
    {% if a == "b" and not loop.first %} ... {% elif ... %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      what the model is to learn
    {{ message.role + ": " }}

Null roles and texts are empty. Rows of equal turn go by role and text, null
turns first; rows with a null conv_id are one conversation. Repeated rows are
turns of their own. No rows give no rows. Extra columns are ignored.
"""

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A piece of output, and whether it is to be learnt.
Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template isn't of this language."""


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list["Node"] = field(default_factory=list)


_TAG = re.compile(r"\{%\s*(.*?)\s*%\}|\{\{\s*(.*?)\s*\}\}", re.S)
_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(==|!=|\+|\(|\))|([A-Za-z_.]+))')
_NAMES = ("message.role", "message.text", "loop.first")


def _tokens(source: str) -> list[Node]:
    out, at = [], 0
    while at < len(source.rstrip()):
        found = _TOKEN.match(source, at)
        if not found:
            raise TemplateError(f"unreadable: {source[at:]!r}")
        text, sign, name = found.groups()
        if text:
            out.append(Node("const", re.sub(
                r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])))
        elif sign or name in ("and", "or", "not"):
            out.append(Node("sign", sign or name))
        elif name in _NAMES:
            out.append(Node("name", name))
        else:
            raise TemplateError(f"no such name: {name}")
        at = found.end()
    return out


#: Binary signs, the loosest first.
_LEVELS = (("or",), ("and",), ("==", "!="), ("+",))


def parse_expression(source: str) -> Node:
    tokens = _tokens(source)

    def take(*signs: str) -> str | None:
        if tokens and tokens[0].kind == "sign" and tokens[0].value in signs:
            return tokens.pop(0).value
        return None

    def level(depth: int) -> Node:
        if depth == len(_LEVELS):
            return single()
        left = level(depth + 1)
        while sign := take(*_LEVELS[depth]):
            left = Node(sign, parts=[left, level(depth + 1)])
        return left

    def single() -> Node:
        if take("not"):
            return Node("not", parts=[level(2)])
        if take("("):
            inner = level(0)
            if not take(")"):
                raise TemplateError(f"no closing bracket: {source!r}")
            return inner
        if not tokens or tokens[0].kind == "sign":
            raise TemplateError(f"something is missing: {source!r}")
        return tokens.pop(0)

    out = level(0)
    if tokens:
        raise TemplateError(f"too much: {source!r}")
    return out


def parse(template: str) -> Node:
    """The tree of a template; a list of nodes under a ``seq``."""
    stack = [Node("seq")]

    def open_block(node: Node) -> None:
        stack[-1].parts.append(node)
        stack.append(node)

    def close(kind: str, tag: str) -> Node:
        if stack[-1].kind != kind:
            raise TemplateError(f"misplaced tag: {tag}")
        return stack.pop()

    at = 0
    for tag in _TAG.finditer(template):
        if tag.start() > at:
            stack[-1].parts.append(Node("const", template[at:tag.start()]))
        at = tag.end()
        statement, expression = tag.groups()
        if expression is not None:
            stack[-1].parts.append(parse_expression(expression))
        elif statement == "for message in messages":
            if any(n.kind == "for" for n in stack):
                raise TemplateError("a loop within a loop")
            open_block(Node("for"))
        elif statement == "endfor":
            close("for", statement)
        elif statement == "generation":
            if any(n.kind == "generation" for n in stack):
                raise TemplateError("a generation within a generation")
            open_block(Node("generation"))
        elif statement == "endgeneration":
            close("generation", statement)
        elif statement.startswith("if "):
            open_block(Node("if"))
            open_block(Node("case", parse_expression(statement[3:])))
        elif statement.startswith("elif ") or statement == "else":
            if close("case", statement).value is None:
                raise TemplateError(f"after else: {statement}")
            open_block(Node("case", parse_expression(statement[5:]) if statement != "else" else None))
        elif statement == "endif":
            close("case", statement)
            close("if", statement)
        else:
            raise TemplateError(f"no such tag: {statement}")
    if at < len(template):
        stack[-1].parts.append(Node("const", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"not closed: {stack[-1].kind}")
    return stack[0]


def fold(node: Node) -> Node:
    """The same tree with everything worked out that is known without a message."""
    parts = [fold(p) for p in node.parts]
    known = bool(parts) and all(p.kind == "const" for p in parts)
    if node.kind in _SIGNS and known:
        return Node("const", _SIGNS[node.kind](*[p.value for p in parts]))
    if node.kind == "if":
        cases = []
        for case in parts:
            test = fold(case.value) if case.value is not None else Node("const", True)
            if test.kind == "const" and not test.value:
                continue
            cases.append(Node("case", test, case.parts))
            if test.kind == "const":
                break
        if cases and cases[0].value.kind == "const":
            return Node("seq", parts=cases[0].parts)
        return Node("if", parts=cases)
    if node.kind in ("seq", "for", "generation", "case"):
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "seq" else [p]:
                if q.kind == "const" and flat and flat[-1].kind == "const":
                    flat[-1] = Node("const", _text(flat[-1].value) + _text(q.value))
                else:
                    flat.append(q)
        return Node(node.kind, node.value, flat)
    return Node(node.kind, node.value, parts)


def _text(value: object) -> str:
    return value if isinstance(value, str) else str(value).lower()


_SIGNS: dict[str, Callable] = {
    "+": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a,
}


def _value(node: Node) -> Callable[[dict], object]:
    if node.kind == "const":
        return lambda names, value=node.value: value
    if node.kind == "name":
        return lambda names, name=node.value: names[name]
    sign, inner = _SIGNS[node.kind], [_value(p) for p in node.parts]
    if len(inner) == 1:
        return lambda names: sign(inner[0](names))
    return lambda names: sign(inner[0](names), inner[1](names))


def _writer(node: Node, learnt: bool) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields what ``node`` renders."""
    if node.kind in ("seq", "generation"):
        inner = [_writer(p, learnt or node.kind == "generation") for p in node.parts]

        def sequence(names):
            for write in inner:
                yield from write(names)
        return sequence
    if node.kind == "for":
        body = _writer(Node("seq", parts=node.parts), learnt)

        def loop(names):
            for number, (role, text) in enumerate(names["messages"]):
                yield from body(names | {
                    "message.role": role, "message.text": text, "loop.first": number == 0})
        return loop
    if node.kind == "if":
        cases = [(_value(c.value), _writer(Node("seq", parts=c.parts), learnt)) for c in node.parts]

        def choose(names):
            for test, write in cases:
                if test(names):
                    yield from write(names)
                    return
        return choose
    value = _value(node)

    def single(names):
        yield _text(value(names)), learnt
    return single


def compile_template(template: str) -> Callable[[Iterable[tuple[str, str]]], Iterator[Piece]]:
    """A function from (role, text) messages to pieces, one message at a time."""
    write = _writer(fold(parse(template)), False)
    none = {"message.role": "", "message.text": "", "loop.first": False}
    return lambda messages: write({"messages": messages} | none)


#: Strings that steer the format, and the template of the query.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|role|>", "<|text|>")
TEMPLATE = (
    '{% for message in messages %}{% if loop.first %}<s>{% endif %}'
    '{% if message.role == "user" %}[INST]{% endif %}<|role|>{{ message.role }}<|text|>'
    '{% if message.role == "assistant" %}{% generation %}{{ message.text }}{% endgeneration %}'
    '{% else %}{{ message.text }}{% endif %}'
    '{% if message.role == "user" %}[/INST]{% endif %}</s>{% endfor %}')

#: A control string is broken by a backslash after its first character. Where
#: some backslashes stand there already, one more is added and taken away.
_HEADS = "".join(sorted({re.escape(c[0]) for c in CONTROLS}))
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_BREAK = re.compile(rf"([{_HEADS}])(\\*)({_TAILS})")
_BROKEN = re.compile(rf"([{_HEADS}])\\(\\*)({_TAILS})")


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1\2\3", text)


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, output) of each turn, read from the output alone."""
    held = ""
    for piece, _ in pieces:
        held += piece
        while piece and (end := held.find("</s>")) >= 0:
            turn, held = held[:end + 4], held[end + 4:]
            head, body = turn.removeprefix("<s>").removeprefix("[INST]").split("<|text|>", 1)
            body = body.removesuffix("</s>").removesuffix("[/INST]")
            yield unescape(head.removeprefix("<|role|>")), unescape(body), turn
    if held:
        raise ValueError("the output ends within a turn")


def format_turns(conversations: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order, in one task.

    A digest over a conversation has to meet its turns one after the other; a
    task reads them as a stream and holds one turn at a time.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text"))


def rendered(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, number, output, learnt): the formatted text of every turn.

    ``learnt`` holds (start, stop) of the generation in ``output``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template)
        out: list[dict] = []
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            # A template may end a turn anywhere, so a turn's pieces are told by
            # the messages drawn: a piece belongs to the last one.
            drawn = [0]

            def messages(rows=rows, drawn=drawn):
                for _, role, text in rows:
                    drawn[0] += 1
                    yield escape(role), escape(text)

            for number, pieces in groupby(write(messages()), key=lambda p: drawn[0]):
                output, learnt = "", []
                for text, marked in pieces:
                    if marked:
                        learnt.append({"start": len(output), "stop": len(output) + len(text)})
                    output += text
                out.append({"conv_id": conv_id, "number": number, "output": output, "learnt": learnt})
                if len(out) >= 500:
                    yield _batch(out, _RENDERED)
                    out = []
        if out:
            yield _batch(out, _RENDERED)

    return format_turns(conversations).mapInArrow(
        run, "conv_id long, number long, output string, learnt array<struct<start:long,stop:long>>")


_RENDERED = pa.schema([
    ("conv_id", pa.int64()), ("number", pa.int64()), ("output", pa.string()),
    ("learnt", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, 500).columns], strict=True)


def _digests(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    write = compile_template(template)
    out: list[dict] = []
    for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
        all_turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = formatted = 0
        learnt: list[str] = []

        def pieces(rows=rows, learnt=learnt):
            for text, marked in write((escape(role), escape(text)) for _, role, text in rows):
                if marked:
                    learnt.append(text)
                yield text, marked

        for role, text, output in read_turns(pieces()):
            all_turns.update(f"{role}\n{text}\n".encode())
            n_turns, formatted = n_turns + 1, formatted + len(output)
            own = unescape("".join(learnt))
            learnt.clear()
            loss.update(own.encode())
            loss_chars += len(own)
        out.append({
            "conv_id": conv_id, "n_turns": n_turns, "turns_sha256": all_turns.hexdigest(),
            "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted})
        if len(out) >= 1000:
            yield _batch(out, _DIGEST)
            out = []
    if out:
        yield _batch(out, _DIGEST)


def query(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(said).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("_r")).select("_r.*")
    every = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return format_turns(every).mapInArrow(
        lambda batches: _digests(batches, template),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long")


#: The control strings, and the lengths of what the template adds.
ORACLE = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
    FROM range(2) AS r(n)),
sized AS (
    SELECT *, 8 + 8 + 4 + CASE role WHEN 'user' THEN 6 + 7 ELSE 0 END
        + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|role\|>|\|text\|>)', '\1x\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|role\|>|\|text\|>)', '\1x\2\3', 'g'))
        AS chars
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
