"""Conversation histories as a stream: the batch operator's bounded history as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.config import ConversationConfig

OUT = "repository_id string, conversation_id string, seq long, role string, content string, n_history int, history array<struct<role:string,content:string>>"


def histories(messages: DataFrame, config: ConversationConfig = ConversationConfig()) -> DataFrame:
    """A stream of messages (repository_id, conversation_id, seq, role, content) with the history that each one's rewrite
    sees. State is the last `history` messages of a conversation; a micro-batch's messages are taken in order of seq."""
    keep, sees = config.history, min(config.rewrite, config.history)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            seen = held[-sees:]
            out.append((*key, r.seq, r.role, r.content, len(seen), [{"role": a, "content": b} for a, b in seen]))
            held = [*held, (r.role, r.content)][-keep:]
        state.update(([[a, b] for a, b in held],))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ("repository_id", "conversation_id", "seq", "role", "content", "n_history", "history")])

    return messages.groupBy("repository_id", "conversation_id").applyInPandasWithState(step, OUT, "messages array<array<string>>", "append", "NoTimeout")
