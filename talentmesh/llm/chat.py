"""Chat formatting: conversations of typed content parts as marked text.

A turn holds parts: text, images, audio, documents.  A visitor flattens them
in order: a text part is escaped, every other part becomes a placeholder, and
what it stands for (reference, tokens it expands to) is recorded in the order
of the placeholders.  The template marks turns and their texts; the loss mask
covers the texts of the chosen roles, without marks and placeholders.

Control strings inside texts and roles are escaped by one more backslash behind their
first character, on the way back one is taken away, so any text returns as it
was, also one that looks escaped already.  No control string has a first
character inside, so escapes never touch each other.

Turns are formatted where they lie; one shuffle brings a conversation's turns
into order.  A conversation is written as chunks of whole turns with its
number, so that no row grows with the number of turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "text"
#: A typed content part; which fields count depends on its kind.
PART = "struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
#: Characters of a chunk; a turn is never parted.
CHUNK_CHARS = 1 << 18


@dataclass(frozen=True)
class Template:
    """Marks of a format.  ``reserved`` are control strings of other formats
    that must not stand in a text either."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "</s>"
    part: str = "<|part|>"
    media: tuple[tuple[str, str], ...] = (("image", "<|image|>"), ("audio", "<|audio|>"), ("document", "<|document|>"), ("", "<|attachment|>"))
    reserved: tuple[str, ...] = ("<s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        firsts = {c[0] for c in self.controls()}
        if any(set(c[1:]) & (firsts | {"\\"}) or len(c) < 2 or c[0] == "\\" for c in self.controls()):
            raise ValueError("a control string must not hold a first character of one, nor a backslash")

    def controls(self) -> list[str]:
        return [self.turn, self.body, self.end, self.part, *(m for _, m in self.media), *self.reserved]

    def patterns(self) -> list[tuple[str, str]]:
        """(first character, pattern of what may follow it) of all control strings."""
        firsts = sorted({c[0] for c in self.controls()})
        return [(f, "|".join(sorted({re.escape(c[1:]) for c in self.controls() if c[0] == f}))) for f in firsts]

    def escape(self, text: Column) -> Column:
        for first, rest in self.patterns():
            text = F.regexp_replace(text, f"{re.escape(first)}(\\\\*)({rest})", f"{first}$1\\\\$2")
        return text

    def unescape(self, text: str) -> str:
        for first, rest in self.patterns():
            text = re.sub(f"{re.escape(first)}(\\\\*)\\\\({rest})", lambda m, f=first: f + m[1] + m[2], text)
        return text

    def marks(self) -> re.Pattern:
        """Placeholders and borders of parts inside a body."""
        return re.compile("|".join(re.escape(m) for m in [self.part, *(m for _, m in self.media)]))


@dataclass(frozen=True)
class PartVisitor:
    """What each kind of part becomes; a method for each kind."""

    template: Template
    image_patch: int = 28
    image_tokens: int = 256
    audio_per_second: float = 25.0
    page_tokens: int = 512

    def visit(self, part: Column, method: str) -> Column:
        """Sends a part to the method of its kind; others are attachments."""
        out = getattr(self, f"{method}_other")(part)
        for kind in ("document", "audio", "image", TEXT):
            out = F.when(F.coalesce(part["kind"], F.lit(TEXT)) == kind, getattr(self, f"{method}_{kind}")(part)).otherwise(out)
        return out

    def _mark(self, kind: str) -> Column:
        return F.lit(dict(self.template.media)[kind])

    def flat_text(self, part: Column) -> Column:
        return self.template.escape(F.coalesce(part["text"], F.lit("")))

    def flat_image(self, part: Column) -> Column:
        return self._mark("image")

    def flat_audio(self, part: Column) -> Column:
        return self._mark("audio")

    def flat_document(self, part: Column) -> Column:
        return self._mark("document")

    def flat_other(self, part: Column) -> Column:
        return self._mark("")

    def tokens_text(self, part: Column) -> Column:
        return F.lit(0).cast("long")

    def tokens_image(self, part: Column) -> Column:
        """Patches of the image; a fixed number where its size is unknown."""
        p = self.image_patch
        patches = F.ceil(part["width"] / p) * F.ceil(part["height"] / p)
        return F.coalesce(patches, F.lit(self.image_tokens)).cast("long")

    def tokens_audio(self, part: Column) -> Column:
        return F.coalesce(F.ceil(part["seconds"] * self.audio_per_second), F.lit(0)).cast("long")

    def tokens_document(self, part: Column) -> Column:
        return (F.coalesce(part["pages"], F.lit(1)).cast("long") * self.page_tokens).cast("long")

    def tokens_other(self, part: Column) -> Column:
        return F.lit(0).cast("long")

    def flatten(self, parts: Column) -> Column:
        """The body: parts in order, a mark between two texts that meet."""
        def is_text(p):
            return F.coalesce(p["kind"], F.lit(TEXT)) == TEXT

        def one(p, i):
            meet = (i > 0) & is_text(p) & is_text(F.get(parts, i - 1))
            return F.concat(F.when(meet, self.template.part).otherwise(""), self.visit(p, "flat"))

        return F.array_join(F.transform(parts, one), "")

    def attachments(self, parts: Column) -> Column:
        media = F.filter(parts, lambda p: F.coalesce(p["kind"], F.lit(TEXT)) != TEXT)
        return F.transform(media, lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), self.visit(p, "tokens").alias("tokens")))


def text_parts(text: Column | str) -> Column:
    """A plain text as the only part of a turn; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    none = [F.lit(None).alias(c) for c in ("uri", "width", "height", "seconds", "pages")]
    return F.array(F.struct(F.lit(TEXT).alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *none)).cast(f"array<{PART}>")


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MEDIA = pa.struct([("at", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())])
_CHUNKS = ("conv_id long, chunk int, start long, text string, loss array<struct<start: long, end: long>>, "
           "attachments array<struct<at: long, kind: string, uri: string, tokens: long>>")
_NAMES = ["conv_id", "chunk", "start", "text", "loss", "attachments"]


def _texts_between(body: str, marks: re.Pattern):
    """(start, end) of the texts of a body, (start) of its placeholders."""
    last, texts, places = 0, [], []
    for m in marks.finditer(body):
        texts.append((last, m.start()))
        places.append((m.start(), m[0]))
        last = m.end()
    return [*texts, (last, len(body))], places


def _chunker(template: Template):
    """Turns in order -> chunks of their conversations."""

    def run(batches):
        marks = template.marks()
        out, size = [], 0
        conv, chunk, start = object(), 0, 0
        texts, loss, media, held = [], [], [], 0

        def close():
            nonlocal texts, loss, media, held, chunk, start, size
            if texts:
                out.append((conv, chunk, start, "".join(texts), loss, media))
                chunk, start, size = chunk + 1, start + held, size + held
            texts, loss, media, held = [], [], [], 0

        for b in batches:
            for key, head, body, in_loss, attached in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != conv:
                    close()
                    conv, chunk, start = key, 0, 0
                elif held and held + len(head) + len(body) > CHUNK_CHARS:
                    close()
                at = start + held + len(head)
                spans, places = _texts_between(body, marks)
                if in_loss:
                    loss += [{"start": at + s, "end": at + e} for s, e in spans if e > s]
                places = [p for p, m in places if m != template.part]
                media += [{"at": at + p, **x} for p, x in zip(places, attached)]
                piece = head + body + template.end
                texts.append(piece)
                held += len(piece)
                if size > 4 * CHUNK_CHARS:
                    yield _chunk_batch(out)
                    out, size = [], 0
        close()
        if out:
            yield _chunk_batch(out)

    return run


def _chunk_batch(rows):
    c = list(zip(*rows))
    types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(_MEDIA))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names=_NAMES)


def format_conversations(turns: DataFrame, parts: Column | str = "parts", template: Template = Template(), visitor: PartVisitor | None = None,
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """(conv_id, chunk, start, text, loss, attachments) in the order of chunks
    within each conversation, all of one in one partition.

    ``text`` holds whole turns; ``start`` is the place of its first character
    in the conversation, ``loss`` the spans of characters that count,
    ``attachments`` the placeholders.  Characters are code points.  Rows go by
    turn, one without a number first, equal ones by role and body; repeated rows are turns of their own.  A null
    role is empty, as are null texts and null lists of parts; null parts are
    left out, a part without a kind is text.  Rows without a conversation form
    one.  Extra columns are ignored.  A very long conversation is sorted and
    chunked by one task, which holds one chunk at a time."""
    visitor = visitor or PartVisitor(template)
    parts = F.col(parts) if isinstance(parts, str) else parts
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
                        F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"))
    head = F.concat(F.lit(template.turn), template.escape(F.col("role")), F.lit(template.body))
    rows = rows.select("conv_id", "turn", head.alias("head"), visitor.flatten(F.col("parts")).alias("body"),
                       F.col("role").isin(list(template.loss_roles)).alias("in_loss"), visitor.attachments(F.col("parts")).alias("attached"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "head", "body")
    return rows.select("conv_id", "head", "body", "in_loss", "attached").mapInArrow(_chunker(template), _CHUNKS)


_TURN = ("conv_id long, chars long, role string, text string, loss_text string, "
         "parts array<struct<kind: string, text: string, uri: string, tokens: long>>")
_READ = pa.struct([("kind", pa.string()), ("text", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())])


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, chars, role, text, loss_text, parts) of every turn, from the
    formatted rows alone and in their order.

    ``chars``: length of the formatted turn; ``text``: its texts joined;
    ``loss_text``: what the loss mask covers, unescaped.  Text that the
    template did not make is refused."""

    def run(batches):
        marks = template.marks()
        kinds = {m: k for k, m in template.media}
        turn = re.compile(f"{re.escape(template.turn)}(.*?){re.escape(template.body)}(.*?){re.escape(template.end)}", re.S)
        for b in batches:
            out = []
            for conv, _, start, text, loss, media in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                done, span, media = 0, 0, iter(media or [])
                loss = loss or []
                for m in turn.finditer(text):
                    if m.start() != done:
                        raise ValueError(f"conversation {conv}: no turn at character {start + done}")
                    done = m.end()
                    texts, places = _texts_between(m[2], marks)
                    parts = []
                    for i, (s, e) in enumerate(texts):
                        # a text part between two marks; none beside a placeholder that has none
                        beside = [p for p in (places[i - 1:i] if i else []) + places[i:i + 1] if p[1] != template.part]
                        if e > s or not beside:
                            parts.append({"kind": TEXT, "text": template.unescape(m[2][s:e]), "uri": None, "tokens": 0})
                        if i < len(places) and places[i][1] != template.part:
                            x = next(media)
                            parts.append({"kind": x["kind"] if not kinds[places[i][1]] else kinds[places[i][1]], "text": None, "uri": x["uri"], "tokens": x["tokens"]})
                    kept = []
                    while span < len(loss) and loss[span]["start"] < start + done:
                        kept.append(template.unescape(text[loss[span]["start"] - start:loss[span]["end"] - start]))
                        span += 1
                    out.append((conv, m.end() - m.start(), template.unescape(m[1]), "".join(p["text"] or "" for p in parts), "".join(kept), parts))
                if done != len(text):
                    raise ValueError(f"conversation {conv}: no turn at character {start + done}")
            if out:
                c = list(zip(*out))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(_READ))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names=["conv_id", "chars", "role", "text", "loss_text", "parts"])

    return formatted.mapInArrow(run, _TURN)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from its turns in order: number, digest of roles and
    texts, characters and digest of the loss texts, formatted characters.  Only the
    state of two digests is held, however long a conversation is."""

    def run(batches):
        out, conv, n = [], object(), 0

        def close():
            if n:
                out.append((conv, n, all_text.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for b in batches:
            for key, size, role, text, lost in zip(*(b.column(c).to_pylist() for c in ("conv_id", "chars", "role", "text", "loss_text"))):
                if not n or key != conv:
                    close()
                    conv, n, all_text, loss, loss_chars, chars = key, 0, sha256(), sha256(), 0, 0
                n += 1
                chars += size
                all_text.update(f"{role}\n{text}\n".encode())
                loss.update(lost.encode())
                loss_chars += len(lost)
            if len(out) > 5000:
                yield _digest_batch(out)
                out.clear()
        close()
        if out:
            yield _digest_batch(out)

    return turns.select("conv_id", "chars", "role", "text", "loss_text").mapInArrow(run, ", ".join(
        f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _DIGESTS))


_DIGESTS = (("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))


def _digest_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows), _DIGESTS)], names=[n for n, _ in _DIGESTS])
