"""A labelled corpus of this library's own: letters in English and Korean with what a reader takes from each.

``LETTERS`` has the words written, the flags that hold, and the promise with its day, if one is made.  ``TAILS``
are quoted mail and signatures put below them, of which nothing was written anew.  ``letter_messages`` deals them
over the events, so that operators on texts run over a whole table whose truth is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.sources.adapters import event_messages

#: (text, flags in short, promised words, day of the promise: days ahead, or a weekday by name)
LETTERS: list[tuple[str, str, str | None, str | None]] = [
    ("Please review the second draft by Friday.", "deadline request strong", None, None),
    ("If possible, could you send the figures again?", "request weak question", None, None),
    ("The server move has been completed.\nNothing else changed.", "completion", None, None),
    ("No action needed on the old order.", "withdrawal", None, None),
    ("Could you check the totals? I see two of them.", "request strong question", None, None),
    ("Lunch was good. The view from the hill was better.", "", None, None),
    ("Is the room free at noon?", "question", None, None),
    ("Let me know what you think of the plan.", "request strong", None, None),
    ("We need the list asap.", "deadline", None, None),
    ("Kindly confirm the date. The ticket was resolved yesterday.", "request strong completion", None, None),
    ("Would you like some tea", "request strong", None, None),
    ("fyi", "trivial", None, None),
    ("++ Mina", "trivial", None, None),
    ("견적서를 금요일까지 보내겠습니다.", "deadline", "견적서를 금요일까지 보내겠습니다.", "friday"),
    ("내일 회의록을 정리하겠습니다.", "", "내일 회의록을 정리하겠습니다.", "1"),
    ("오늘 안에 초안을 공유하겠습니다.", "deadline", "오늘 안에 초안을 공유하겠습니다.", "0"),
    ("모레 오전에 자료를 올리겠습니다.", "", "모레 오전에 자료를 올리겠습니다.", "2"),
    ("다음 주 화요일 회의를 잡겠습니다.", "", "다음 주 화요일 회의를 잡겠습니다.", "next tuesday"),
    ("요청하신 내용은 제가 처리하겠습니다.", "", "요청하신 내용은 제가 처리하겠습니다.", None),
    ("수요일까지 회신 부탁드립니다.", "deadline request strong", None, None),
    ("이번 안건은 승인 부탁드립니다.", "decision request strong", None, None),
    ("서버 점검을 완료했습니다.", "completion", None, None),
    ("참고 부탁드립니다.", "trivial", None, None),
    ("회의실 안내문 참고 부탁드립니다.", "", None, None),
    ("지난번 요청은 취소합니다.", "withdrawal", None, None),
    ("각 담당자는 일정 확인 부탁드립니다.", "request weak group", None, None),
    ("시간 되시면 의견 주시면 좋겠습니다.", "decision request weak", None, None),
    ("받은 문서는 이상 없습니다.", "completion", None, None),
    ("예산은 이대로 가능한가요?", "request strong question", None, None),
    ("날씨가 맑습니다.", "", None, None),
    ("다음 달 일정은 아직 모릅니다.\nWe will talk about it later.", "", None, None),
]
#: Quoted mail and signatures below a letter.
TAILS = (
    "", "\n\nOn Mon, 8 Jan 2024 at 10:00, Kim <kim@home.test> wrote:\n> Please review this by Monday.\n> Thanks", "\n-----Original Message-----\nFrom: a@b.test\nCould you send it asap?",
    "\n\nFrom: a@b.test\nSent: Monday\nTo: c@d.test\nSubject: old\nPlease reply by Friday.", "\n--\nKim Nara\nPlease visit us", "\n\n2024년 1월 8일 (월) 김나라 <kim@home.test>님이 작성:\n> 회신 부탁드립니다.",
)
FLAG_NAMES = {
    "has_deadline": "deadline", "has_decision": "decision", "has_request": "request", "has_strong_request": "strong", "has_weak_request": "weak", "has_question": "question",
    "has_completion": "completion", "has_withdrawal": "withdrawal", "mentions_group": "group", "is_trivial": "trivial",
}


def letter_messages(events: DataFrame) -> DataFrame:
    """Events as messages whose body is a letter and a tail by the event's number; flags are left to be found."""
    m = event_messages(events).drop(*FLAG_NAMES)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    return m.withColumn("body", F.concat(pick([x[0] for x in LETTERS], F.col("id")), pick(TAILS, F.floor(F.col("id") / len(LETTERS)))))


def _quoted(text: str | None) -> str:
    if text is None:
        return "NULL::VARCHAR"
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _truth() -> str:
    rows = []
    for k, (own, flags, promise, due) in enumerate(LETTERS):
        held = ", ".join(str(short in flags.split()).lower() for short in FLAG_NAMES.values())
        rows.append(f"({k}, {_quoted(own)}, {_quoted(promise)}, {_quoted(due)}, {held})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(k, own, promise, due, {', '.join(FLAG_NAMES)})"


#: The truth in SQL, a row a letter: k, own, promise, due and the flags.
TRUTH_SQL = _truth()
N_LETTERS = len(LETTERS)
