"""Sinks: JSON lines, plain text, mail files and mail."""

from __future__ import annotations

import logging
import os
import smtplib
from dataclasses import dataclass
from email.message import EmailMessage
from email.utils import formataddr, formatdate, make_msgid

from pyspark.sql import DataFrame

from tidemark.config import Config

log = logging.getLogger(__name__)


def append_json(df: DataFrame, path: str) -> bool:
    """Appends JSON lines; a failure is logged and returned, for an audit must not stop a run."""
    try:
        df.write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001
        log.warning("audit not written: %s", e)
        return False
    return True


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Smtp:
    host: str
    port: int = 587
    user: str = ""
    password: str = ""
    timeout: float = 20

    def send(self, message: EmailMessage) -> None:
        with smtplib.SMTP(self.host, self.port, timeout=self.timeout) as server:
            server.starttls()
            if self.user:
                server.login(self.user, self.password)
            server.send_message(message)


def smtp_from(config: Config) -> Smtp | None:
    """The configured server, None where no host is set."""
    return Smtp(config.smtp_host, config.smtp_port, config.smtp_user, config.smtp_password) if config.smtp_host else None


def message(subject: str, plain: str, html: str, to: list[str], config: Config) -> EmailMessage:
    mail = EmailMessage()
    mail["Subject"], mail["From"] = subject, formataddr(("Digest", config.sender))
    if to:
        mail["To"] = ", ".join(to)
    mail["Date"], mail["Message-ID"] = formatdate(localtime=True), make_msgid(domain="digest.invalid")
    mail.set_content(plain)
    mail.add_alternative(html, subtype="html")
    return mail


def save(mail: EmailMessage, folder: str, name: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.eml")
    with open(path, "wb") as f:
        f.write(mail.as_bytes())
    return path


def delivered(mails: DataFrame, to: list[str], config: Config, stamp: str, smtp: Smtp | None = None) -> dict[str, list]:
    """Sends or saves each part, one at a time on the driver: {'sent': subjects, 'saved': paths}. Without recipients or a server, or
    in a dry run, parts are only saved; so is what can't be sent."""
    done: dict[str, list] = {"sent": [], "saved": []}
    dry = config.dry_run or not to or smtp is None
    for row in mails.orderBy("part").toLocalIterator():
        mail, failed = message(row["subject"], row["plain"], row["html"], to, config), False
        if not dry:
            try:
                smtp.send(mail)
                done["sent"].append(row["subject"])
            except (OSError, smtplib.SMTPException) as e:
                log.warning("part %d not sent: %s", row["part"], e)
                failed = True
        if dry or failed or config.save_preview:
            done["saved"].append(save(mail, config.outbox, f"{stamp}-{row['part']:03d}"))
    return done
