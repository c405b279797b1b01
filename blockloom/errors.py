"""Exceptions by layer: chain, store, planning, dispatch and handlers."""


class BlockloomError(Exception):
    retryable = False


class ChainError(BlockloomError):
    pass


class RateLimited(ChainError):
    retryable = True


class TransportError(ChainError):
    retryable = True


class BlockUnavailable(ChainError):
    retryable = True


class DecodeError(ChainError):
    pass


class RpcFatal(ChainError):
    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class WrongNetwork(ChainError):
    pass


class StoreError(BlockloomError):
    pass


class IdentityMismatch(StoreError):
    pass


class UnsupportedType(StoreError):
    pass


class ConfigError(BlockloomError):
    pass


class LineageError(BlockloomError):
    pass


class HandlerError(BlockloomError):
    pass
