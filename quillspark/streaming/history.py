"""Chat history kept as messages come: the last few of each conversation as keyed state, which expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions import constants as K

STATE = "turns array<long>, roles array<string>, texts array<string>"
OUT = "conv_id {kind}, newest long, history string"


def histories(messages: DataFrame, last: int = 6, roles: dict[str, str] = K.HISTORY_ROLES, expires_ms: int | None = 30 * 24 * 3600 * 1000) -> DataFrame:
    """conv_id, newest (turn) and history of every conversation that a batch has messages of: what functions.prompts.history() gives for all of its messages so far.

    messages: a stream of conv_id, turn, role, text; turns tell messages of a conversation apart and come in any order and any number of times. history is null where no line
    of a known role is left; null roles and texts are as in the table. A conversation without messages for expires_ms is forgotten and begins anew; Spark looks
    for such ones in batches without data, so a query with expiry runs on until it is stopped: with the trigger availableNow give expires_ms=None. The state of a conversation
    is `last` messages, in the state store and its checkpoint; conversations are dealt by their hash, and a batch's messages of one are read in parts."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    named = dict(roles)

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(state.get[0], zip(state.get[1], state.get[2], strict=True), strict=True)) if state.exists else {}
        for some in parts:
            held |= dict(zip(some["turn"].tolist(), zip(some["role"].tolist(), some["text"].tolist(), strict=True), strict=True))
            held = {t: held[t] for t in sorted(held)[-last:]}
        turns = list(held)
        state.update((turns, [held[t][0] for t in turns], [held[t][1] for t in turns]))
        if expires_ms:
            state.setTimeoutDuration(expires_ms)
        lines = [": ".join(x for x in (named[held[t][0]], held[t][1]) if x is not None) for t in turns[:-1] if held[t][0] in named]
        yield pd.DataFrame({"conv_id": [key[0]], "newest": [turns[-1]], "history": ["\n".join(lines) if lines else None]})

    rows = messages.select("conv_id", "turn", "role", "text").where("turn is not null").groupBy("conv_id")
    return rows.applyInPandasWithState(keep, OUT.format(kind=kind), STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if expires_ms else GroupStateTimeout.NoTimeout)
