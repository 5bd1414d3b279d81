"""Text functions: Column in, Column out, all on Spark built-ins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.config import DEFAULT, Config

#: White space that trimming removes, and what does not end a line for `.`.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_IN_LINE = r"[^\n\r\u2028\u2029]"
_LINE_START = r"(?:(?<=[\n\r\u2028\u2029])|\A)"

#: Phrases that point back to an earlier conversation.
DEICTIC = (
    r"as (?:I|we) (?:mentioned|said|discussed|talked about)",
    r"what we (?:just|were) (?:discussing|talking about)",
    r"(?:continue|go on|keep going|pick up where)",
    r"that (?:thing|idea|approach|plan|issue|bug|feature|task)",
    r"like (?:I|we) said",
    r"remember when",
    r"back to (?:the|that|what)",
    r"where (?:we|I) left off",
)
#: Words of prompts that are no conversation.
SYSTEM_WORDS = ("HEARTBEAT", "boot check")


def trim(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.btrim(text, F.lit(SPACES))  # linear, where a regex tries every run of spaces inside


def let(value: Column, f) -> Column:
    """f(value) with the value bound once, so that an expression that names it often does not grow."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@dataclass(frozen=True)
class Block:
    """What is removed from an opener (a pattern) to the next closer (a text). `needs`: texts that must both follow an opener somewhere."""

    opener: str
    closer: str
    needs: tuple[str, ...] = ()

    @property
    def whole(self) -> str:
        return rf"(?s)(?:{self.opener}).*?{re.escape(self.closer)}"


def blocks(config: Config = DEFAULT) -> list[Block]:
    """The kinds of blocks in the order of their removal. Openers never try the same white space twice."""
    inner = _SPACE[1:-1]
    fence = rf"```json[{inner.replace(chr(92) + 'n', '', 1)}]*+\n{_SPACE}*+\{{"
    tags = [Block(re.escape(f"<{t}>"), f"</{t}>") for t in (config.context_tag, config.continuity_tag, config.memories_tag)]
    schema = rf'{fence}["{inner}]*+schema["{inner}]*+:{_SPACE}*+"{re.escape(config.inbound_schema)}'
    return [*tags, Block(schema, "```"), Block(fence, "```", ('"label"', '"sender"'))]


def last_start(text: Column, part: str) -> Column:
    """Where a part starts for the last time, from 0; negative if it does not occur."""
    return F.length(text) - F.length(F.substring_index(text, part, -1)) - len(part)


def locate(part: str, text: Column, start: Column) -> Column:
    """Where a part starts for the first time from a place (0 is the first) on; -1 if it does not occur there."""
    return F.call_function("locate", F.lit(part), text, (start + 1).cast("int")) - 1


def without_blocks(text: Column, block: Block) -> Column:
    """Text without a kind of block, in one pass.

    A lazy search for a closer that is not there reads all that is left, again for every opener. So the text is cut behind
    the last closer that an opener can reach: before the cut every search ends at a closer, and behind it nothing is removed.
    """

    def cut(t: Column) -> Column:
        behind = last_start(t, block.closer) + len(block.closer)
        if not block.needs:
            return behind
        # Openers count up to where the rarer need starts for the last time; the last of them reaches the next closer from there on.
        reach = F.least(*[last_start(t, n) for n in block.needs])
        return let(reach, lambda r: F.when(r < 0, 0).otherwise(let(locate(block.closer, t, F.greatest(r, F.lit(0))), lambda c: F.when(c >= 0, c + len(block.closer)).otherwise(behind))))

    def removed(t: Column) -> Column:
        return let(cut(t), lambda n: F.concat(F.regexp_replace(F.left(t, n), block.whole, ""), F.substr(t, n + 1)))

    return let(text, lambda t: F.when(t.contains(block.closer), removed(t)).otherwise(t))


def without_noise(text: Column) -> Column:
    """Text without marked lines, dates in front of lines and null characters, with at most one blank line in a row. Only a text with a step's mark is searched."""
    steps = [
        ("[Subagent Context]", rf"{_LINE_START}\[Subagent Context\]{_IN_LINE}*", ""),
        ("[", rf"{_LINE_START}\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun){_SPACE}+\d{{4}}-\d{{2}}-\d{{2}}{_SPACE}+\d{{2}}:\d{{2}}{_SPACE}+[A-Za-z]{{2,5}}\][ \t]*", ""),
        ("\0", r"\x00", ""),
        ("\n\n\n", r"\n{3,}", "\n\n"),
    ]
    return reduce(lambda text, s: let(text, lambda t: F.when(t.contains(s[0]), F.regexp_replace(t, s[1], s[2])).otherwise(t)), steps, text)


def sanitize(text: Column, config: Config = DEFAULT) -> Column:
    """Text without injected blocks, metadata and noise; the order of the steps matters. Time grows with the text's length."""
    return trim(without_noise(reduce(without_blocks, blocks(config), text)))


def extract_content(content: Column, blocks: Column | None = None, least: int = 20) -> Column:
    """A string longer than least, or the joined text blocks longer than least; else null."""
    plain = F.when(F.length(content) > least, content)
    if blocks is None:
        return plain
    kept = F.filter(blocks, lambda b: (b["type"] == "text") & (F.length(b["text"]) > least))
    return F.coalesce(plain, F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda b: b["text"]), "\n")))


def has_deictic(text: Column) -> Column:
    """Whether a text refers to an earlier conversation; word bounds are ASCII ones."""
    return F.coalesce(text.rlike(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(DEICTIC) + r")(?![A-Za-z0-9_])"), F.lit(False))


def is_gap(count: Column, event: Column | None = None, threshold: int = DEFAULT.gap_threshold) -> Column:
    """Whether recent conversation was probably lost."""
    few = count <= threshold
    return few if event is None else F.coalesce(event.isin("bootstrap", "compact"), F.lit(False)) | few


def prompt_passes(prompt: Column, config: Config = DEFAULT) -> Column:
    """Whether a prompt is long enough and no system prompt."""
    system = reduce(lambda a, w: a | prompt.contains(w), SYSTEM_WORDS, F.lit(False))
    return F.coalesce((F.length(prompt) >= config.min_prompt_length) & ~system, F.lit(False))


def episode_name(prefix: str, session_key: Column, now_ms: Column) -> Column:
    """prefix[-session]-milliseconds."""
    return F.concat_ws("-", F.lit(prefix), F.nullif(session_key, F.lit("")), now_ms.cast("string"))


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+?(\.[^.]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def is_indexable(path: Column, extensions: tuple[str, ...] = DEFAULT.index_extensions) -> Column:
    """Whether the extension is one of those asked for (given with or without a dot, in any case)."""
    return file_extension(path).isin([(e if e.startswith(".") else f".{e}").lower() for e in extensions])


#: Tools that write files, and the parameters that may name one.
WRITE_TOOLS = ("Write", "Edit", "write", "edit", "write_file", "create_file")
PATH_KEYS = ("file_path", "path", "filePath", "target_file")


def memory_path(tool: Column, params: Column) -> Column:
    """The path from `memory/` on that a writing tool names (params: map of strings); else null."""
    found = []
    for key in PATH_KEYS:
        value = params[key]
        at = F.instr(value, "/memory/")
        found.append(F.when(at > 0, F.substr(value, at + 1)).when(value.startswith("memory/"), value))
    return F.when(tool.isin(*WRITE_TOOLS), F.coalesce(*found))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), F.lit(False))


def time_ago(then: Column, now: Column) -> Column:
    """Age of a timestamp in whole minutes, hours or days."""
    s = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1_000_000)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(f"{name} ago"))
    return F.when(then.isNull(), "").when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def index_name(path: Column) -> Column:
    return F.concat(F.lit("memory-index::"), path)


def index_content(path: Column, modified: Column, excerpt: Column, size: Column) -> Column:
    """Front matter of six lines and the excerpt."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value.cast("string"))
    return F.concat_ws("\n", F.lit("---"), F.lit("type: memory-index"), line("file", path), line("last_modified", modified), line("size", size), F.lit("---"), excerpt)


def context_block(lines: Column, config: Config = DEFAULT) -> Column:
    """A tagged block of recalled facts."""
    return F.concat(F.lit(f"<{config.context_tag}>\nRelevant knowledge graph facts (auto-recalled):\n"), lines, F.lit(f"\n</{config.context_tag}>"))


def continuity_block(text: Column, config: Config = DEFAULT) -> Column:
    """A tagged block of recovered conversation."""
    return F.concat(F.lit(f"<{config.continuity_tag}>\nRecent session context (recovered from transcript):\n"), text, F.lit(f"\n</{config.continuity_tag}>"))


def fact_line(name: Column, fact: Column) -> Column:
    return F.concat(F.lit("- **"), name, F.lit("**: "), fact)


def count_facts(block: Column) -> Column:
    return F.size(F.regexp_extract_all(block, F.lit(r"(?m)^- \*\*"), F.lit(0)))


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def log_value(text: Column) -> Column:
    """Escaped, and quoted if it holds a space."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    return F.when(out.contains(" "), F.concat(F.lit('"'), out, F.lit('"'))).otherwise(out)


def log_line(ts: Column, event: Column, fields: list[tuple[str, Column]], tag: str = "memloom") -> Column:
    """`ts [tag] event k=v ...`; the event is padded to 12 and never cut; null values are dropped."""
    padded = F.when(F.length(event) < 12, F.rpad(event, 12, " ")).otherwise(event)
    pairs = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), log_value(v.cast("string"))) for k, v in fields])
    return F.concat(ts, F.lit(f" [{tag}] "), padded, F.lit(" "), pairs)
