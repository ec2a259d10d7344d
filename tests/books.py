"""Small literal tables for the tests."""

import datetime as dt
from decimal import Decimal

from ledgerloom import schemas as S

DAY = dt.date(2026, 6, 1)


def D(value):
    return Decimal(str(value)).quantize(Decimal("0.01"))


def day(n):
    return DAY + dt.timedelta(days=n)


class Books:
    """Small literal tables, line numbers in the order the rows are added."""

    def __init__(self, close_id="c1"):
        self.close_id, self.st, self.bk, self.ld = close_id, [], [], []

    def pay(self, txn, batch, gross, on=0, fee=None, gst=None, utr=None, order=None,
            method="card", kind="payment"):
        fee = D(0) if fee is None else D(fee)
        gst = D(0) if gst is None else D(gst)
        self.st.append((self.close_id, len(self.st) + 2, txn, batch, utr, kind, D(gross), fee, gst,
                        day(on), order, method))
        return self

    def credit(self, txn, amount, on=0, text="", utr=None):
        self.bk.append((self.close_id, len(self.bk) + 2, txn, D(amount), day(on), text, utr))
        return self

    def entry(self, txn, amount, on=0, order="o", status="captured"):
        self.ld.append((self.close_id, len(self.ld) + 2, order, txn, D(amount), day(on), status))
        return self

    def frames(self, spark):
        return (spark.createDataFrame(self.st, S.SETTLEMENT),
                spark.createDataFrame(self.bk, S.BANK), spark.createDataFrame(self.ld, S.LEDGER))
