"""The registered chat query against plain Python: turns and loss text of every conversation, -7 included."""

import hashlib

from presage.llm import queries
from presage.session import table

SF = "/root/testdata/sf0.01"
HARD = r"\### Assistant: </turn> ok"


def test_registered_query(spark):
    talks = {-7: [(0, "user", HARD), (1, "assistant", HARD)]}
    for r in table(spark, SF, "conversations").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        want[conv] = (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)), len(loss), sha(loss))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.Q.builders["op3_chat_formatting"](spark, SF).collect()}
    assert got == want
