"""A telephone directory given as lines: parsed by parts that hand on their ends, and made into contacts."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

from .spread import running, settled

#: lines of one part, and how far a rule looks ahead
PART, AHEAD = 4096, 3
# Fixed value: the word that stands under a heading.
UNDER_HEADING = "전화번호부"
#: what a part must know of the lines before it: lines already taken, whether the last organization is still without entries, whether there is one
STATES = [(taken, fresh, started) for taken, fresh, started in product(range(3), (False, True), (False, True))]
TOKENS = "doc string, n long, kind string, text string, raw string"


def tokens(lines: list[tuple], first: int, state: tuple, sections: frozenset) -> tuple[list[tuple], tuple]:
    """What ``lines`` (text, is a number, is a label; the last AHEAD only looked at) say, entered in a state, and the state in which they are left.

    A line begins a section (a section's name that stands twice, over the heading word, or over a name that does), else an
    organization (a label that stands twice or over the heading word; a label over two labels and a number), else is an entry with the number
    under it, else a group of entries. A label that stands twice over a number right after an organization's begin is an entry of its.
    """
    taken, fresh, started = state
    own, out = len(lines) - AHEAD, []
    for k in range(own):
        if taken:
            taken -= 1
            continue
        (l, num, label), (n1, num1, label1), (n2, num2, label2), (_, num3, _) = lines[k : k + 4]
        begins = n1 in (l, UNDER_HEADING)
        if l in sections and (begins or label1 and n2 in (n1, UNDER_HEADING)):
            out.append((first + k, "section", l, None))
            taken, fresh, started = int(begins), True, True
        elif label and begins:
            if fresh and n1 == l and num2:
                out.append((first + k, "entry", l, n2))
                taken, fresh = 2, False
            else:
                out.append((first + k, "organization", l, None))
                taken, fresh, started = 1, True, True
        elif label and label1 and label2 and num3 and not any(x.startswith("- ") for x in (l, n1, n2)):
            out.append((first + k, "organization", l, None))
            fresh, started = True, True
        elif num:
            out.append((first + k, "unmatched", l, None))
        elif num1:
            out.append((first + k, "entry" if started else "unmatched", l, n1))
            taken, fresh = 1, False
        else:
            out.append((first + k, "unmatched" if l.startswith("- ") else "group", l, None))
    return out, (taken, fresh, started)


def parsed(lines: DataFrame, sections: list[str]) -> DataFrame:
    """``lines(doc string, n long, line string)`` to ``doc, n, kind, text, raw``: sections, organizations, groups, entries with their numbers, and
    unmatched lines, by the number of the line that says so (lines without text are not counted).

    Lines are numbered along their order and cut into parts of PART lines with the AHEAD next ones. Each part is read once for every state in which it
    may be entered; from the states in which it is left, 12 numbers, follows where each part of a directory really begins, and it is read for good.
    So no directory is parsed by one task, however long. Null lines are lines without text. No lines: no rows.
    """
    names = frozenset(sections)
    rows = lines.where(F.coalesce(F.length("line"), F.lit(0)) > 0).select("doc", "n", "line").withColumn("key", F.struct("doc", "n")).withColumn("one", F.lit(1))
    rows = running(rows, "key", sums=("one",)).select("doc", F.col("one_before").alias("at"), "line")
    rows = rows.join(F.broadcast(rows.groupBy("doc").agg(F.min("at").alias("start"))), "doc")  # one row per directory
    rows = rows.select("doc", (F.col("at") - F.col("start")).alias("n"), "line", T.is_number_line(F.col("line")).alias("number"))
    rows = rows.withColumn("label", ~F.col("number") & (F.col("line") != UNDER_HEADING))
    part = F.floor(F.col("n") / PART)
    rows = settled(rows.withColumn("part", F.explode(F.when((F.col("n") % PART < AHEAD) & (part > 0), F.array(part, part - 1)).otherwise(F.array(part)))))

    def read(batch: pd.DataFrame) -> tuple[list[tuple], int]:
        batch = batch.sort_values("n")
        got = list(zip(batch.line, batch.number, batch.label))
        own = int((batch.n // PART == batch.part).sum())
        return got[: own + AHEAD] + [("", False, False)] * (own + AHEAD - len(got)), int(batch.n.iloc[0])

    def ways(batch: pd.DataFrame) -> pd.DataFrame:
        got, first = read(batch)
        return pd.DataFrame({"doc": [batch.doc.iloc[0]], "part": [batch.part.iloc[0]], "leaves": [[STATES.index(tokens(got, first, s, names)[1]) for s in STATES]]})

    def enters(batch: pd.DataFrame) -> pd.DataFrame:
        batch, at, out = batch.sort_values("part"), STATES.index((0, False, False)), []
        for leaves in batch.leaves:
            out.append(at)
            at = leaves[at]
        return pd.DataFrame({"doc": batch.doc, "part": batch.part, "enter": out})

    states = rows.groupBy("doc", "part").applyInPandas(ways, "doc string, part long, leaves array<int>").groupBy("doc").applyInPandas(enters, "doc string, part long, enter int")

    def known(batch: pd.DataFrame) -> pd.DataFrame:
        got, first = read(batch)
        out, _ = tokens(got, first, STATES[batch.enter.iloc[0]], names)
        return pd.DataFrame([(batch.doc.iloc[0], *x) for x in out], columns=["doc", "n", "kind", "text", "raw"])

    return settled(rows.join(states, ["doc", "part"]).groupBy("doc", "part").applyInPandas(known, TOKENS))


def contacts(found: DataFrame, campuses: dict[str, str]) -> DataFrame:
    """Tokens of ``parsed`` to contacts: ``doc, n, section, organization, grp, label, service, channels`` (array of kind and number, in order).

    An entry belongs to the last section and organization before it, and, if its label begins with a dash, to the last group after that organization.
    A fax entry's numbers go to the organization's last entry before it; without one it is dropped, as there is nobody to reach. Directly under a section
    each entry is an organization of its own. ``campuses`` tells by which campus the numbers of each
    directory are completed.
    """
    heads = F.col("kind").isin("section", "organization")
    steps = found.withColumns({
        "key": F.struct("doc", "n"), "s": F.when(F.col("kind") == "section", F.struct("doc", "text")), "o": F.when(heads, F.struct("doc", "n", "text")),
        "g": F.when(heads | (F.col("kind") == "group"), F.struct("doc", F.when(~heads, F.col("text")).alias("text"))),
        "fax": (F.col("kind") == "entry") & (F.lower(F.trim(F.regexp_replace("text", "^- ", ""))) == "fax"),
    })
    steps = steps.withColumn("e", F.when((F.col("kind") == "entry") & ~F.col("fax"), F.struct("doc", "n")))
    e = running(steps, "key", last=("s", "o", "g", "e")).where("kind = 'entry' AND e_last.doc = doc AND e_last.n >= o_last.n")
    dashed = F.col("text").startswith("- ")
    section = F.when(F.col("s_last.doc") == F.col("doc"), F.col("s_last.text"))
    full = F.coalesce(*(F.when(F.col("doc") == doc, T.phone_numbers(F.col("raw"), campus)) for doc, campus in campuses.items()))
    numbers = F.transform(full, lambda x: F.struct(F.when(F.col("fax"), "fax").otherwise("phone").alias("kind"), x.alias("number")))
    e = e.select("doc", F.col("e_last.n").alias("entry"), "n", "fax", section.alias("section"), F.col("o_last.text").alias("organization"), F.when(dashed & (F.col("g_last.doc") == F.col("doc")), F.col("g_last.text")).alias("grp"), F.trim(F.regexp_replace("text", "^- ", "")).alias("label"), numbers.alias("channels"))
    own = F.struct("section", "organization", "grp", "label")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "channels"))), lambda x: x["channels"]))
    got = e.groupBy("doc", "entry").agg(F.max(F.when(~F.col("fax"), own)).alias("own"), listed.alias("channels"))
    implicit = F.col("own.organization") == F.col("own.section")
    service = F.when(F.coalesce(implicit, F.lit(False)), "대표 문의").when(F.col("own.grp").isNotNull() & (F.col("own.grp") != F.col("own.label")), F.concat("own.grp", F.lit(" · "), "own.label")).otherwise(F.col("own.label"))
    named = F.when(F.coalesce(implicit, F.lit(False)), F.col("own.label")).otherwise(F.col("own.organization"))
    return got.select("doc", F.col("entry").alias("n"), "own.section", named.alias("organization"), "own.grp", "own.label", service.alias("service"), "channels")
