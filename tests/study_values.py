"""Short forms of the dates and times that the study's tests write out."""

import datetime as dt


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
