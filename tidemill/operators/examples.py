"""One conversation to many training rows, as a table function that SQL can call.

    spark.udtf.register("conversation_examples", conversation_examples())
    SELECT * FROM conversation_examples(TABLE(conversations), context => 3)

The function asks for its table dealt by conversation and sorted by turn (``analyze``), so callers need
not.  It streams a conversation and holds its last few messages only, whatever its length.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEEDED = ("conv_id", "turn", "role", "text")


class ConversationExamples:
    """One row for each answer of the assistant: the messages before it, at most ``context`` of them, and the answer.

    ``step`` counts the answers of a conversation from 0.  A null text counts as empty; an answer with no
    message before it has an empty context; rows without a conversation form one; an empty table has no rows.
    """

    @staticmethod
    def analyze(table, context=None):
        from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn

        if not table.isTable:
            raise ValueError("the first argument must be a table")
        if missing := [c for c in NEEDED if c not in table.dataType.names]:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        if context is not None and (context.value is None or context.value < 1):
            raise ValueError("context must be at least 1")
        kind = table.dataType["conv_id"].dataType
        schema = T.StructType().add("conv_id", kind).add("turn", table.dataType["turn"].dataType).add("step", "long").add("n_context", "long").add("context", "string").add("answer", "string")
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("conv_id")], orderBy=[OrderingColumn("turn"), OrderingColumn("role")])

    def __init__(self):
        self.step, self.held = 0, None

    def eval(self, row, context=4):
        if self.held is None:
            self.held = deque(maxlen=context)
        if row["role"] == "assistant":
            yield row["conv_id"], row["turn"], self.step, len(self.held), "\n".join(self.held), row["text"] or ""
            self.step += 1
        self.held.append(f"{row['role']}: {row['text'] or ''}")


def conversation_examples():
    """The table function, for a call from Python or ``spark.udtf.register``."""
    return F.udtf(ConversationExamples)


def examples(conversations: DataFrame, context: int = 4) -> DataFrame:
    return conversation_examples()(conversations.select(*NEEDED).asTable(), context=F.lit(context))
