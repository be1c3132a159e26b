"""A messy workbook to try an audit on: two sheets whose faults are planted by rule."""

from __future__ import annotations

from dqscan.sources.reports import write_xlsx

FIRST = ("Mara", "Teo", "Ines", "Ravi", "Lena", "Omar", "Yuki", "Dario")
LAST = ("Quist", "Abara", "Lindqvist", "Moreau", "Okafor", "Tanaka", "Velez")


def customers(n: int) -> list[list[str | None]]:
    """Rows of which every third date, every fourth phone and so on is out of line; see the comments."""
    rows: list[list[str | None]] = [["CustomerID", "Name", "Email", "Phone", "JoinDate", "Balance", "Status", "Notes"]]
    for k in range(n):
        name = f"{FIRST[k % len(FIRST)]} {LAST[k // len(FIRST) % len(LAST)]}"
        email: str | None = name.lower().replace(" ", ".") + "@example.com"
        phone, date = f"(555) 01{k % 10}-{k % 10000:04}", f"2024-{k % 12 + 1:02}-{k % 28 + 1:02}"
        row = [f"CUST-{k:05}", name, email, phone, date, f"${k * 7 % 9000}.00", ("Active", "Closed")[k % 2], None]
        if k % 3 == 1:
            row[4] = f"{k % 12 + 1:02}/{k % 28 + 1:02}/2024"  # another date format
        if k % 4 == 2:
            row[3] = f"555.01{k % 10}.{k % 10000:04}"  # another phone format
        if k % 10 == 5:
            row[5] = "not known yet"  # text among amounts
        if k % 10 == 7:
            row[1] = f"REF-{k}"  # a code for a name
        if k % 10 == 8:
            row[2] = "no address"  # no email
        if k % 6 == 0:
            row[6] = "ACTIVE"  # another spelling
        if k % 9 == 4:
            row[7] = "TBD"  # a placeholder
        rows.append(row)
        if k % 20 == 19:
            rows.append([f"CUST-9{k:05}", f" {(row[1] or '').upper()} ", *row[2:]])  # the row again, spelled otherwise
    return rows


def orders(n: int) -> list[list[str | None]]:
    """Rows of which every eighth is entered twice, and every fifth has no shipping date."""
    rows: list[list[str | None]] = [["OrderID", "CustomerID", "OrderDate", "Amount", "ShipDate"]]
    for k in range(n):
        row = [f"CUST-{k % 50:05}", f"2024-{k % 12 + 1:02}-{k % 28 + 1:02}", f"${k * 13 % 700}.50", None if k % 5 == 0 else f"2024-{k % 12 + 1:02}-{k % 28 + 1:02}"]
        rows += [[f"ORD-{len(rows) + i:05}", *row] for i in range(2 if k % 8 == 0 else 1)]
    return rows


def write_sample(path: str, n: int = 200) -> str:
    """Writes the workbook, with about `n` rows a sheet."""
    return write_xlsx(path, {"Customers": customers(n), "Orders": orders(n)})
