"""Small message tables."""

import datetime as dt

from mailspark import schema

# Mail of a garden club:
# gmail_id, thread, subject, from, to, date, archive, offset, length, preview
CORPUS = [
    ("swap", "t1", "Seed swap on Saturday", "nora@garden.example", "club@garden.example",
     "2022-04-02T09:00:00", "spring.mbox", 0, 700,
     "Bring your spare seeds and pots to the swap on Saturday."),
    ("reply", "t1", "Re: Seed swap on Saturday", "omar@garden.example", "nora@garden.example",
     "2022-04-03T18:20:00", "spring.mbox", 700, 650,
     "I will bring tomato seeds and two watering cans."),
    ("minutes", "t2", "Minutes of the committee", "petra@garden.example", "club@garden.example",
     "2022-05-11T20:45:00", "spring.mbox", 1350, 2300,
     "The committee approved the new fence. Cost of the fence is 340 euros."),
    ("offer", "t3", "Fence offer 77", "sales@timber.example", "petra@garden.example",
     "2022-05-19T07:05:00", "offers.mbox", 0, 900,
     "Our offer for the fence: 310 euros including delivery."),
    ("bees", "t4", "Beekeeping visitors", "quinn@bees.example", "friends@garden.example",
     "2022-06-21T12:00:00", "summer.mbox", 0, 1200, None),
    ("rota", "t5", "Watering rota for July", "nora@garden.example", "club@garden.example",
     "2022-06-28T08:30:00", "summer.mbox", 1200, 800,
     "Please sign up for the watering rota before the holidays start."),
    ("supper", "t6", "Harvest supper", "rosa@kitchen.example", "club@garden.example",
     "2022-09-17T16:10:00", "autumn.mbox", 0, 1500,
     "Harvest supper after the committee meeting, please bring plates."),
    ("arrival", "t3", "Delivery of the fence", "sales@timber.example", "petra@garden.example",
     "2022-06-02T10:00:00", "offers.mbox", 900, 400,
     "The fence arrives on Thursday; payment is due on delivery."),
    ("accounts", "t7", "Accounts for the year", "petra@garden.example", "club@garden.example",
     "2021-12-30T22:15:00", "winter.mbox", 0, 600,
     "Accounts of the garden club for the year, with seeds and fence."),
]

LATER = dt.datetime(2025, 1, 1)


def message(gmail_id=None, rfc=None, archive="a.mbox", offset=0, length=100, **more):
    row = {name: None for name in schema.MESSAGES.names}
    row.update(gmail_id=gmail_id, rfc_message_id=rfc or f"<{gmail_id}@example.com>",
               archive_file=archive, mbox_offset=offset, mbox_length=length,
               archived_timestamp=LATER, account_id="default")
    row.update(more)
    return row


def table(spark, rows):
    return spark.createDataFrame(
        [tuple(r[n] for n in schema.MESSAGES.names) for r in rows], schema.MESSAGES)


def corpus(spark):
    return table(spark, [
        message(g, f"<{g}@gmail>", a, o, n, thread_id=t, subject=s, from_addr=f, to_addr=to,
                date=dt.datetime.fromisoformat(d), date_raw=d, body_preview=p, size_bytes=n)
        for g, t, s, f, to, d, a, o, n, p in CORPUS])


def mail(number, subject="Subject", body="Body text\n", message_id=None, date=None, extra=""):
    """One raw message."""
    date = date or f"Mon, {number:02d} Jan 2024 12:00:00 +0000"
    message_id = f"<m{number}@example.com>" if message_id is None else message_id
    head = (f"From: alice@example.com\nTo: bob@example.com\nSubject: {subject}\n"
            + (f"Message-ID: {message_id}\n" if message_id else "") + f"Date: {date}\n{extra}")
    return (head + "\n" + body).encode()


def mbox_text(mails):
    out = b""
    for raw in mails:
        out += b"From alice@example.com Mon Jan 01 00:00:00 2024\n" + raw
        out += b"" if raw.endswith(b"\n") else b"\n"
        out += b"\n"
    return out
