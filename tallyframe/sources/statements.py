"""Text statements: labelled lines are cut into blocks, one block per record.

A block ends where one of its keys would appear a second time. The rule is sequential, but a
block has at most as many entries as there are keys. A stretch of lines therefore only needs to
know how many of its first entries belong to a block begun earlier. Each stretch is solved for
every such number on its own, the few numbers are chained per file, and the stretches are cut
with the right one, all stretches in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import strip
from tallyframe.operators.parse import clean_text, is_minor, reject_reasons
from tallyframe.schema import AMOUNT, EXTENDED_FIELDS, REPORT, STANDARD_FIELDS, conform
from tallyframe.storage import spread, written

# Fixed values: (field, labels, accepted text), tried in this order on every line.
LABELS = (
    ("investor_name", r"(?:Name|Investor Name)", r"[A-Za-z\s.]+"),
    ("mobile", r"(?:Mobile|Phone|Contact)", r"[0-9\+\-\s]+"),
    ("total_amount", r"(?:Amount|Balance|Value)", r"[0-9,]+\.?[0-9]*"),
    ("folio_number", r"(?:Folio|Folio Number|Folio No)", r"[A-Za-z0-9\/]+"),
    ("email", r"(?:Email|Email Address)", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("tax_status", r"(?:Tax Status|Taxability|Tax Category)", r"[A-Za-z\s./-]+"),
    ("date_of_birth", r"(?:Date of Birth|DOB|Birth Date|Birthdate)", r"[0-9A-Za-z\s./-]+"),
    ("bank_name", r"(?:Bank Name|Bank)", r"[A-Za-z\s./-]+"),
    ("bank_account", r"(?:Bank Account|Account No|Account Number|A/c)", r"[0-9]+"),
    ("ifsc", r"(?:IFSC|IFSC Code)", r"[A-Z0-9]{11}"),
    ("registered_address", r"(?:Address|Registered Address)", r"[A-Za-z0-9\s.,/-]+"),
    ("mode_of_holding", r"(?:Mode of Holding|Holding Mode|Mode)", r"[A-Za-z\s./-]+"),
    ("nominee_1", r"(?:Nominee 1|Nominee Name|Nominee)", r"[A-Za-z\s./-]+"),
    ("nominee_relation", r"(?:Nominee Relation|Relation|Relation/Percentage)", r"[A-Za-z\s./%0-9-]+"),
    ("distributor_arn", r"(?:Distributor|ARN|Broker Code|Distributor \(ARN\))", r"[A-Za-z0-9\s./%-]+"),
)
PAN_LABELLED = r"(?iU)PAN\s*:\s*([A-Z0-9]{10})"
PAN_BARE = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"

KEYS = ("pan", *[field for field, _, _ in LABELS])
LINES_PER_STRETCH = 200_000


def _found(lines: DataFrame) -> DataFrame:
    """Add a column per key, `_<key>`: the text found on a line, null where its label is absent.

    The steps are separate columns, so that each pattern runs once per line. The text is taken out of the
    part that matched, where the pattern finds what it found in the line, as it looks at nothing around it.
    """
    def cut(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.col("_line"), pattern, 1), F.lit(""))

    patterns = {field: f"(?iU){label}\\s*:\\s*({text})" for field, label, text in LABELS}
    out = lines.withColumn("_line", strip(F.col("line"))).withColumns({
        "_pan": F.upper(strip(F.coalesce(cut(PAN_LABELLED), cut(PAN_BARE)))),
        **{f"_{field}": F.regexp_extract(F.col("_line"), pattern, 0) for field, pattern in patterns.items()},
    })
    # Presence of the label decides; the captured text may be blank after trimming.
    out = out.withColumns({
        f"_{field}": F.when(F.col(f"_{field}") != "", strip(F.regexp_extract(F.col(f"_{field}"), pattern, 1)))
        for field, pattern in patterns.items()
    })
    out = out.withColumns({"_digits": F.regexp_replace("_mobile", r"\D", ""), "_amount": F.regexp_replace("_total_amount", ",", "")})
    digits, amount = F.col("_digits"), F.col("_amount")
    return out.withColumns({
        "_mobile": F.when((F.length(digits) > 10) & digits.startswith("91"), F.substring(digits, 3, 1 << 30)).otherwise(digits),
        "_total_amount": F.when(amount.try_cast(AMOUNT).isNotNull(), amount),
    })


def statement_entries(lines: DataFrame, stretch: int = LINES_PER_STRETCH) -> DataFrame:
    """(file_id, file_name, file_path, stretch, seq, key, value) of every labelled text.

    `lines` has file_id, file_name, line_no, line and, if known, file_path.
    """
    if "file_path" not in lines.columns:
        lines = lines.withColumn("file_path", F.concat_ws("/", "file_id", "file_name"))
    entries = F.array_compact(F.array(*[
        F.when(F.col(f"_{key}").isNotNull(), F.struct(F.lit(i).alias("key_no"), F.lit(key).alias("key"), F.col(f"_{key}").alias("value")))
        for i, key in enumerate(KEYS)
    ]))
    return _found(spread(lines, *_FILE, "line_no")).select(*_FILE, "line_no", F.inline(entries)).select(
        *_FILE, F.floor(F.col("line_no") / stretch).alias("stretch"),
        (F.col("line_no") * len(KEYS) + F.col("key_no")).alias("seq"), "key_no", "key", "value",
    )


_FILE = ["file_id", "file_name", "file_path"]


def _jumps():
    """Nested so that it travels to the tasks by value."""

    def jumps(keys: list[int]) -> list[int]:
        """For each entry taken as a block start, the index of the first repeated key after it."""
        out, seen, end = [], set(), 0
        for start, key in enumerate(keys):
            while end < len(keys) and keys[end] not in seen:
                seen.add(keys[end])
                end += 1
            out.append(end)
            seen.discard(key)
        return out

    return jumps


def _solve():
    jumps, most = _jumps(), len(KEYS)

    def solve(place, entries, halo):
        """Entries of the next stretch that belong to a block begun here, and the blocks begun
        here, for every number of own entries that belong to an earlier block."""
        import pandas as pd

        own = entries.sort_values("seq")["key_no"].tolist()
        following = list(halo["following"].iloc[0]) if len(halo) else []
        jump, n = jumps(own + following), len(own)
        over, begun = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            end = jump[i]
            over[i], begun[i] = (end - n, 1) if end >= n else (over[end], begun[end] + 1)
        inside = range(most + 1)
        return pd.DataFrame([{
            "file_id": place[0], "file_name": place[1], "file_path": place[2], "stretch": place[3],
            "over": [over[e] if e < n else e - n for e in inside],
            "begun": [begun[e] if e < n else 0 for e in inside],
        }])

    return solve


def _chain():
    def chain(stretches):
        """Walk the stretches of a file: how each is entered and the blocks begun before it."""
        import pandas as pd

        rows, inside, before = [], 0, 0
        for r in stretches.sort_values("stretch").itertuples():
            rows.append((r.file_id, r.file_name, r.file_path, r.stretch, inside, before))
            inside, before = r.over[inside], before + r.begun[inside]
        return pd.DataFrame(rows, columns=["file_id", "file_name", "file_path", "stretch", "inside", "before"])

    return chain


def _cut():
    jumps = _jumps()

    def cut(entries, entered):
        """Number the block of every entry of a stretch."""
        entries = entries.sort_values("seq")
        inside, block = int(entered["inside"].iloc[0]), int(entered["before"].iloc[0])
        jump, numbers, at = jumps(entries["key_no"].tolist()), [], 0
        numbers += [block] * min(inside, len(jump))
        at = len(numbers)
        while at < len(jump):
            block += 1
            numbers += [block] * (jump[at] - at)
            at = jump[at]
        return entries.assign(block_no=numbers)[["file_id", "file_name", "file_path", "block_no", "key", "value"]]

    return cut


def statement_blocks(lines: DataFrame, stretch: int = LINES_PER_STRETCH) -> DataFrame:
    """(file_id, file_name, file_path, block_no, entries MAP) of every block; blocks count from 1."""
    place = [*_FILE, "stretch"]
    entries = written(statement_entries(lines, stretch))  # some thirty patterns per line, read three times
    narrow = entries.select(*place, "seq", "key_no")
    heads = (
        narrow.withColumn("_no", F.row_number().over(Window.partitionBy(*place).orderBy("seq")))
        .filter(F.col("_no") <= len(KEYS))
        .groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("seq", "key_no"))).alias("_head"))
    )
    ahead = Window.partitionBy(*_FILE).orderBy("stretch").rowsBetween(1, len(KEYS))
    halo = heads.select(
        *[F.col(c).alias(c) for c in place],  # fresh attributes: both sides stem from the same lines
        F.slice(F.flatten(F.collect_list("_head").over(ahead)), 1, len(KEYS)).getField("key_no").alias("following"),
    )
    layout = "file_id string, file_name string, file_path string, stretch bigint, "
    solved = narrow.groupBy(*place).cogroup(halo.groupBy(*place)).applyInPandas(
        _solve(), layout + "over array<int>, begun array<bigint>"
    )
    entered = solved.groupBy(*_FILE).applyInPandas(_chain(), layout + "inside int, before bigint")
    cut = entries.select(*place, "seq", "key_no", "key", "value").groupBy(*place).cogroup(
        entered.groupBy(*place)
    ).applyInPandas(_cut(), "file_id string, file_name string, file_path string, block_no bigint, key string, value string")
    return cut.groupBy(*_FILE, "block_no").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("entries")
    )


def parse_statements(lines: DataFrame, source: str = "PDF_CAS") -> DataFrame:
    """Typed rows of statements, one per block, in the layout of `parse_table`."""
    entry = F.col("entries")
    texts = ("pan", "investor_name", "mobile", "email", "folio_number", "tax_status", *EXTENDED_FIELDS)
    present = {f: F.map_contains_key(entry, f) for f in STANDARD_FIELDS}

    def names(test) -> Column:
        return F.array_compact(F.array(*[F.when(test(f), F.lit(f)) for f in STANDARD_FIELDS])).cast("array<string>")

    typed = statement_blocks(lines).select(
        *_FILE,
        F.lit(source).alias("source"),
        F.col("block_no").alias("raw_row_index"),
        F.col("block_no").alias("row_number"),
        *[clean_text(entry[f]).alias(f) for f in texts],
        F.coalesce(entry["total_amount"], F.lit("0.00")).cast(AMOUNT).alias("total_amount"),
        F.coalesce(entry["total_amount"], F.lit("0.00")).alias("total_amount_text"),
        is_minor(entry["tax_status"]).alias("is_minor_account"),
        names(lambda f: ~present[f]).alias("missing_fields"),
        names(lambda f: present[f] & (strip(entry[f]) == "")).alias("empty_fields"),
        entry.alias("raw_data"),
    )
    typed = typed.withColumn("reasons", reject_reasons(source, None))
    return conform(typed, REPORT, ("row_number", "raw_data", "reasons"))
