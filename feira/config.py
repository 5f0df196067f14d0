"""Parameters shared by the curated tables and the reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

Quarter = tuple[int, int]


def quarters_of(year: int) -> tuple[Quarter, ...]:
    """The four ``(year, quarter)`` pairs of a calendar year."""
    return tuple((year, q) for q in (1, 2, 3, 4))


@dataclass(frozen=True)
class Windows:
    """Reporting periods. Every report names the one it uses; none is global.

    The purchase reports run one quarter longer than the sign-up reports, and
    the funnel's buyers do not, so the four periods are separate fields.
    """

    signups: tuple[Quarter, ...] = quarters_of(2022)
    purchases: tuple[Quarter, ...] = quarters_of(2022) + ((2023, 1),)
    funnel_buyers: tuple[Quarter, ...] = quarters_of(2022)
    funnel_last_quarter: tuple[Quarter, ...] = ((2022, 4),)


@dataclass(frozen=True)
class Config:
    """Business rules.

    ``dedup_key`` decides what one customer row stands for: ``"address"`` ranks
    clients by the client id found on the address, so all clients without an
    address share one group per first name; ``"client"`` ranks each client on
    its own.

    ``text_collation`` applies to the text keys reports group and rank by and
    to the status tests. The binary default keeps hash aggregation;
    ``"UNICODE_CI_AI"`` ignores case and accents.
    """

    # fixed values
    cancelled_statuses: tuple[str, ...] = ("Cancelado", "Pagamento recusado")
    test_seller_pattern: str = "%- Test%"
    active_status: str = "Ativo"
    deleted_email: str = "deleted"
    wholesale: str = "ATACADO"
    minimarket: str = "MINIMARKET"
    retail: str = "VAREJO"
    invalid_state: str = "1"

    dedup_key: str = "address"
    text_collation: str = "UTF8_BINARY"
    as_of: date | None = None
    windows: Windows = field(default_factory=Windows)

    def __post_init__(self) -> None:
        if self.dedup_key not in ("address", "client"):
            raise ValueError(f"dedup_key must be 'address' or 'client', not {self.dedup_key!r}")
