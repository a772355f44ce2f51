"""What is particular to one archive and event: hosts, paths, phrases and names. Everything else is general.

A profile is read from JSON; fields that it leaves out keep these neutral values."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Profile:
    archive_host: str = "archive.example.org"
    official_hosts: tuple[str, ...] = ("example.org",)
    official_credit: str = "Photo courtesy of the archive"
    event_name: str = "Festival"
    event_phrases: tuple[str, ...] = ("festival",)
    context_markers: tuple[str, ...] = ("festival",)
    listing_path: str = "/archive/"
    discovery_paths: tuple[str, ...] = ("/", "/archive/")
    detail_markers: tuple[str, ...] = ("/installation/", "/installations/", "/artwork/", "/artworks/")
    listing_file_pattern: str = r"^Listing-(\d{4}).*\.csv$"
    link_year_pattern: str = r"(?i)(?:^|/)(20\d{2})-installations"
    uid_pattern: str = "a2I[A-Za-z0-9]+"
    art_archive_host: str = "publicartarchive.org"
    official_names: tuple[str, ...] = ()
    skip_phrases: tuple[str, ...] = ("Art Installation", "United States", "Public Art", "All Rights", "Privacy Policy", "Terms Of", "Home Page", "About Us", "Contact Us")
    source_name: str = "Archive"
    source_namespace: str = "archive"
    contract_version: str = "csv_v1"
    context_tag: str = "festival"

    @classmethod
    def load(cls, path: str) -> Profile:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        known = {x.name for x in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known})


DEFAULT = Profile()
