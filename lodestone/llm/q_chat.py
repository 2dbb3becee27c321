"""op8: all conversations formatted, and read back from the output."""

from __future__ import annotations

from lodestone.llm import chat
from lodestone.llm.common import Scratch, read

SAID = "</s>[INST] ok [/INST]"


def op8_chat_incremental(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    blocks = Scratch(spark, "chat").cut(chat.format_chats(rows.unionByName(more)))
    return chat.read_back(blocks)


QUERIES = {"op8_chat_incremental": op8_chat_incremental}
ORACLE_SQL = {}
