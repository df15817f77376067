"""SQL dumps as DataFrames of statements.

A dump is read in pieces that end at ``;`` + newline, in parallel over the splits
of every file. Nearly every piece is one statement and goes straight through. Only
where a separator stands inside a quoted text, a comment or a routine do pieces belong together.
Whether it does depends on all the text before it, so the state at the end of each
piece is followed through the file: for the few pieces that change it, first within
each split and then over one small row per split. The text itself is never
shuffled, but for the pieces that have to be put together.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ddl import ROUTINE, strip_leading_comments
from ..storage import BROADCAST_LIMIT_BYTES, broadcast_if_small, size_in_bytes, written

# States between two pieces: outside, in a literal, in a double-quoted or backticked
# text, in a block comment; in small letters the same inside the body of a routine. A
# change is the states that a piece ends in when it starts in each of these.
STATES = "NSDKBnsdkb"
OUTSIDE = "N"
OPENERS = {"S": "'", "D": '"', "K": "`", "B": "/*"}
CLOSERS = OPENERS | {"B": "*/"}

RESET = OUTSIDE * len(STATES)  # the change of a piece after which nothing is open any more

MAX_STATEMENT_BYTES = 2_000_000_000  # of one value

DOUBLE_QUOTE = "\ue000"  # stands for an escaped one while its surroundings are looked at

# What stands for a backslash and the character after it.
ESCAPES = {
    "\\'": "''",
    '\\"': DOUBLE_QUOTE,
    "\\n": "\n",
    "\\r": "\r",
    "\\t": "\t",
    "\\b": "\b",
    "\\0": "\0",
    "\\Z": "\x1a",
}


def _tokens(backslash: bool) -> str:
    single = r"'(?:[^'\\]++|\\.)*+'" if backslash else r"'[^']*+'"
    double = r"\"(?:[^\"\\]++|\\.)*+\"" if backslash else r"\"[^\"]*+\""
    return r"[^;'\"`/#-]++|" + single + "|" + double + r"|`[^`]*+`|(?:--|#)[^\n]*+|/\*.*?\*/"


def _left_open(text: Column, backslash: bool) -> Column:
    """The state in which a text that starts outside ends, routines apart."""
    opener = r"(?s)^(?:" + _tokens(backslash) + r"|[;-]|/(?!\*))*+('|\"|`|/\*)?"
    mark = F.regexp_extract(text, opener, 1)
    found = F.when(mark == "'", "S")
    for state in "DKB":
        found = found.when(mark == OPENERS[state], state)
    return found.otherwise(OUTSIDE)


def _state_after(text: Column, backslash: bool) -> Column:
    """The state in which a text that starts outside ends.

    A routine with BEGIN goes on after its piece, unless the piece has its END too.
    """
    state = _left_open(text, backslash)
    bare = strip_leading_comments(text)
    opens = bare.rlike(ROUTINE) & bare.rlike(r"(?i)\bbegin\b") & ~bare.rlike(r"(?is);\s*end\s*$")
    return F.when(opens, F.lower(state)).otherwise(state)


def _state_in_routine(text: Column, backslash: bool) -> Column:
    """The state in which a text that starts in the body of a routine ends: END closes it."""
    is_end = strip_leading_comments(text).rlike(r"(?i)^end(?:\s+[`\"]?\w+[`\"]?)?\s*$") & ~strip_leading_comments(text).rlike(
        r"(?i)^end\s+(?:if|case|loop|repeat|while)\s*$"
    )
    return F.when(is_end, OUTSIDE).otherwise(F.lower(_left_open(text, backslash)))


def scan_pieces(
    spark: SparkSession,
    paths: str | list[str],
    line_sep: str = ";\n",
    backslash_escapes: bool = False,
) -> DataFrame:
    """Raw pieces in file order: (path, block, seq, piece, after).

    ``block`` is the offset of the file split, ``seq`` counts on within it, and
    ``after`` is the state at the end of the piece if it starts outside.
    """
    return spark.read.text(paths, lineSep=line_sep).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("piece"),
        _state_after(F.col("value"), backslash_escapes).alias("after"),
    )


def _splits(pieces: DataFrame) -> DataFrame:
    """The first number and the count of each split, and the pieces before it in its file.

    One small row per split, some 8,000 for each TB of a file.
    """
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = pieces.groupBy("path", "block").agg(
        F.min("seq").alias("first"), F.count("seq").alias("n")
    )
    return sizes.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _changes(pieces: DataFrame, backslash_escapes: bool) -> DataFrame:
    """Pieces that may change the state: (path, block, seq, change)."""
    piece = F.col("piece")

    def from_inside(state: str) -> Column:
        again = _left_open(F.concat(F.lit(OPENERS[state]), piece), backslash_escapes)
        return F.when(piece.contains(CLOSERS[state]), again).otherwise(state)

    inside = [from_inside(state) for state in STATES[1:5]]
    change = F.concat(
        "after", *inside, _state_in_routine(piece, backslash_escapes), *[F.lower(state) for state in inside]
    )
    changes = pieces.select("path", "block", "seq", change.alias("change"))
    return changes.where(F.col("change") != STATES)


def _in_turn() -> Callable[[str, str], str]:
    """Two changes, one after the other, as one."""
    known: dict[tuple[str, str], str] = {}

    def then(first: str, second: str) -> str:
        if (first, second) not in known:
            known[first, second] = first.translate(str.maketrans(STATES, second))
        return known[first, second]

    return then


def _within_splits(changes: DataFrame) -> DataFrame:
    """For each changing piece, the change from the start of its split to its end."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        then, so_far, out = _in_turn(), STATES, []
        rows = rows.sort_values("seq")
        for change in rows["change"]:
            so_far = then(so_far, change)
            out.append(so_far)
        return rows.assign(change=out)

    schema = "path string, block long, seq long, change string"
    return changes.groupBy("path", "block").applyInPandas(follow, schema)


def _across_splits(splits: DataFrame) -> DataFrame:
    """The states at the start and end of each split, from the changes of the splits before it."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        states = [OUTSIDE]
        rows = rows.sort_values("block")
        for change in rows["change"]:
            states.append(change[STATES.index(states[-1])])
        return rows.assign(start=states[:-1], end=states[1:]).drop(columns="change")

    schema = "path string, block long, first long, n long, n_before long, start string, end string"
    return splits.groupBy("path").applyInPandas(follow, schema)


def _fragments(changes: DataFrame, splits: DataFrame) -> DataFrame:
    """The pieces of statements of several pieces: (path, block, seq, stmt_no).

    The state only changes at the given pieces, so that the pieces between two of
    them are known from their numbers.
    """
    split = ["path", "block"]
    spots = changes.join(broadcast_if_small(splits), split).select(
        *split,
        "seq",
        F.substring("change", F.instr(F.lit(STATES), F.col("start")), F.lit(1)).alias("after"),
        (F.col("n_before") + F.col("seq") - F.col("first")).alias("piece_no"),
    )
    # A split that starts inside gets a spot just before its first piece.
    entered = splits.where(F.col("start") != OUTSIDE).select(
        *split, (F.col("first") - 1).alias("seq"), F.col("start").alias("after"), F.lit(None).cast("long").alias("piece_no")
    )
    order = W.partitionBy(*split).orderBy("seq")
    spots = spots.unionByName(entered)
    spots = spots.withColumn("before", F.lag("after", 1, OUTSIDE).over(order))
    spots = spots.withColumn(
        "opened",
        F.when((F.col("before") == OUTSIDE) & (F.col("after") != OUTSIDE), F.col("piece_no")),
    )
    spots = spots.select(
        "*",
        F.last("opened", ignorenulls=True).over(order).alias("stmt_no"),
        F.lead("seq").over(order).alias("next"),
    )

    # What is open at the start of a split was opened last in the splits before it.
    last_opened = spots.groupBy(*split).agg(F.max("opened").alias("opened"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = splits.join(last_opened, split, "left").select(
        *split,
        (F.col("first") + F.col("n")).alias("end"),
        F.last("opened", ignorenulls=True).over(earlier).alias("carried"),
    )
    inside = F.col("after") != OUTSIDE
    first = F.when(
        F.col("piece_no").isNotNull() & (inside | (F.col("before") != OUTSIDE)), F.col("seq")
    ).otherwise(F.col("seq") + 1)
    last = F.when(inside, F.coalesce("next", "end") - 1).otherwise(F.col("seq"))
    return (
        spots.join(carried, split)
        .select(*split, F.coalesce("stmt_no", "carried").alias("stmt_no"), first.alias("lo"), last.alias("hi"))
        .where(F.col("lo") <= F.col("hi"))
        .select(*split, F.explode(F.sequence("lo", "hi")).alias("seq"), "stmt_no")
    )


def _runaways(pieces: DataFrame, fragments: DataFrame, states: DataFrame, max_bytes: int) -> DataFrame:
    """(path, block, seq) of the piece, in each file, that opens the first statement which has no end.

    That is one still open where its file ends, but for a comment, or one of more than ``max_bytes``: most
    likely a quote that belongs to no pair. Only lengths are added up, over the pieces in question.
    """
    last = states.groupBy("path").agg(F.max_by("end", "block").alias("end"))
    unclosed = last.where(~F.col("end").isin(OUTSIDE, "B", "b")).select("path")
    of_file = fragments.join(unclosed, "path").groupBy("path").agg(F.max("stmt_no").alias("stmt_no"))
    lengths = pieces.select("path", "block", "seq", (F.octet_length("piece") + 2).cast("long").alias("n"))
    sizes = lengths.join(fragments, ["path", "block", "seq"]).groupBy("path", "stmt_no").agg(F.sum("n").alias("n"))
    too_long = sizes.where(F.col("n") > max_bytes).groupBy("path").agg(F.min("stmt_no").alias("stmt_no"))
    first = of_file.unionByName(too_long).groupBy("path").agg(F.min("stmt_no").alias("stmt_no"))
    opened = fragments.join(first, ["path", "stmt_no"]).groupBy("path").agg(F.min(F.struct("block", "seq")).alias("at"))
    return opened.select("path", "at.block", "at.seq")


def _followed(
    pieces: DataFrame, splits: DataFrame, backslash_escapes: bool, max_bytes: int
) -> DataFrame:
    """The pieces of statements of several pieces, runaway ones given up; see ``_fragments``.

    Of a runaway statement the first piece stands alone, and what follows is read as if it had
    ended there: by its rejects it is known, and all other statements of its file are
    found. The states of the files concerned are followed again for each.
    """
    split = ["path", "block"]
    raw = written(_changes(pieces, backslash_escapes), "dump-changes")
    resets = None
    while True:
        changed = raw
        if resets is not None:
            given_up = resets.withColumn("given_up", F.lit(True))
            changed = raw.join(broadcast_if_small(given_up), [*split, "seq"], "left").select(
                *split, "seq", F.when(F.col("given_up"), RESET).otherwise(F.col("change")).alias("change")
            )
        changes = written(_within_splits(changed), "dump-state-changes")
        at_end = changes.groupBy(*split).agg(F.max_by("change", "seq").alias("change"))
        entered = _across_splits(splits.join(at_end, split, "left").fillna({"change": STATES}))
        states = written(entered, "dump-split-states")
        fragments = written(_fragments(changes, states.drop("end")), "dump-fragments")
        found = written(_runaways(pieces, fragments, states, max_bytes), "dump-runaways")
        if found.isEmpty():
            return fragments
        resets = found if resets is None else written(resets.unionByName(found), "dump-resets")


def fold_pieces(
    pieces: DataFrame,
    line_sep: str = ";\n",
    backslash_escapes: bool = False,
    max_statement_bytes: int = MAX_STATEMENT_BYTES,
) -> DataFrame:
    """(path, stmt_no, stmt): pieces as statements, those that belong together joined.

    ``stmt_no`` is the number in the file of a statement's first piece.
    """
    split, columns = ["path", "block"], ["path", "stmt_no", "stmt"]
    splits = written(_splits(pieces), "dump-splits")
    numbered = pieces.join(broadcast_if_small(splits), split).select(
        *split,
        "seq",
        (F.col("n_before") + F.col("seq") - F.col("first")).alias("stmt_no"),
        F.col("piece").alias("stmt"),
    )
    # Files in which some piece does not end outside; only these are looked at again,
    # if their list is small enough to broadcast, else all files.
    unclear = pieces.where(F.col("after") != OUTSIDE).select("path").distinct()
    size = size_in_bytes(unclear)
    if size == 0:
        return numbered.select(*columns)
    again = pieces
    if size <= BROADCAST_LIMIT_BYTES:
        again = pieces.join(F.broadcast(unclear), "path", "left_semi")

    fragments = broadcast_if_small(_followed(again, splits, backslash_escapes, max_statement_bytes))
    whole = numbered.join(fragments, [*split, "seq"], "left_anti").select(*columns)
    parts = F.sort_array(F.collect_list(F.struct("block", "seq", "piece")))
    folded = (
        pieces.join(fragments, [*split, "seq"])
        .groupBy("path", "stmt_no")
        .agg(F.array_join(parts["piece"], line_sep).alias("stmt"))
    )
    return whole.unionByName(folded.select(*columns))


def standard_quotes(stmt: Column) -> Column:
    """A statement with the escapes of its literals written the standard way."""

    def unescape(part: Column) -> Column:
        for escape, text in ESCAPES.items():
            part = F.replace(part, F.lit(escape), F.lit(text))
        return part

    # Doubled backslashes are taken out first: what follows them is not escaped.
    parts = F.array_join(F.transform(F.split(stmt, r"\\\\"), unescape), "\\")

    def double_quote(part: Column) -> Column:
        written_so = F.when(F.startswith(part, F.lit('"')), F.lit('""')).otherwise(F.lit('"'))
        return F.replace(part, F.lit(DOUBLE_QUOTE), written_so)

    # An escaped double quote is doubled in a text of double quotes, and else stays one.
    quoted = F.regexp_extract_all(parts, F.lit(r"(?s)'(?:[^']++|'')*+'|\"[^\"]*+\"|[^'\"]++|['\"]"), F.lit(0))
    whole = F.when(F.contains(parts, F.lit(DOUBLE_QUOTE)), F.array_join(F.transform(quoted, double_quote), "")).otherwise(parts)
    return F.when(F.contains(stmt, F.lit("\\")), whole).otherwise(stmt)


def split_statements(statements: DataFrame, backslash_escapes: bool = False) -> DataFrame:
    """Split what still holds several statements, and drop blanks and mere comments."""
    one = r"(?s)(?:" + _tokens(backslash_escapes) + r"|[/\"'`-])++"
    is_routine = strip_leading_comments(F.col("stmt")).rlike(ROUTINE)
    several = F.when(
        F.contains("stmt", F.lit(";")) & ~is_routine, F.regexp_extract_all("stmt", F.lit(one), F.lit(0))
    ).otherwise(F.array("stmt"))
    parts = (
        statements.select("path", "stmt_no", F.posexplode_outer(several).alias("part_no", "part"))
        .select("path", "stmt_no", "part_no", strip_leading_comments(F.col("part")).alias("stmt"))
        .where(F.col("stmt") != "")
    )
    return parts.withColumn("stmt", standard_quotes(F.col("stmt"))) if backslash_escapes else parts


def scan_dump(
    spark: SparkSession,
    paths: str | list[str],
    line_sep: str = ";\n",
    backslash_escapes: bool = False,
    staging: str | None = None,
    max_statement_bytes: int = MAX_STATEMENT_BYTES,
) -> DataFrame:
    """The statements of SQL dumps: (path, stmt_no, part_no, stmt), without their ``;``.

    (stmt_no, part_no) is the order in the file; part_no counts statements that
    share a line. The pieces are written once to ``staging`` (by default below
    ``spark.checkpoint.dir``), since their numbers must not be derived twice. Use
    ``line_sep=";\\r\\n"`` for dumps with Windows line ends, and
    ``backslash_escapes`` for dumps that write a quote as ``\\'``. A quote that is never closed
    costs the statement it stands in and no other, and so does one that would make a statement of
    more than ``max_statement_bytes``.
    """
    pieces = scan_pieces(spark, paths, line_sep, backslash_escapes)
    pieces = written(pieces, "dump-pieces", staging)
    return split_statements(fold_pieces(pieces, line_sep, backslash_escapes, max_statement_bytes), backslash_escapes)
