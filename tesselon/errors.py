"""Errors with stable codes."""

from __future__ import annotations


class TesselonError(Exception):
    code = "ERROR"
    exit_status = 1


class ConfigError(TesselonError):
    code, exit_status = "CONFIG_INVALID", 2


class NotIndexedError(TesselonError):
    code, exit_status = "NOT_INDEXED", 3


class IndexingError(TesselonError):
    code = "INDEX_FAILED"


class NotFoundError(TesselonError):
    code, exit_status = "NODE_NOT_FOUND", 4


class AmbiguousError(TesselonError):
    code, exit_status = "NODE_AMBIGUOUS", 4


class ProviderError(TesselonError):
    code, exit_status = "PROVIDER_FAILED", 5


class ProviderNotConfiguredError(ProviderError):
    code = "PROVIDER_NOT_CONFIGURED"


class PluginError(TesselonError):
    code, exit_status = "PLUGIN_FAILED", 6


class StoreError(TesselonError):
    code = "STORE_FAILED"
