"""Schemas of the data model. Heights are bigint, hashes and addresses lower-case 0x hex, 256-bit integers decimal strings."""

from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("height", T.LongType(), False), T.StructField("hash", T.StringType(), False), T.StructField("parent_hash", T.StringType()), T.StructField("timestamp", T.TimestampType())])
#: A block as a node answers it: every quantity is a hex string.
RAW_TRANSACTION = "hash string, blockHash string, blockNumber string, transactionIndex string, `from` string, `to` string, value string, input string"
RAW_BLOCK = f"number string, hash string, parentHash string, timestamp string, transactions array<struct<{RAW_TRANSACTION.replace(' string', ':string')}>>"
RAW_LOG = "blockHash string, blockNumber string, transactionHash string, transactionIndex string, logIndex string, removed boolean, address string, topics array<string>, data string"
OPERATION = "height long, handler_seq long, op_seq long, op string, entity string, id string, data string"
POINTER = "struct<height:bigint,hash:string>"

FINAL, UNFINALIZED = "final", "unfinalized"

# Network names and poll intervals in milliseconds by chain id.
CHAIN_NAMES = {"1": "ethereum", "10": "optimism", "56": "bsc", "137": "polygon", "8453": "base", "42161": "arbitrum", "43114": "avalanche", "11155111": "sepolia"}
BLOCK_INTERVAL_MS = {"1": 12_000, "10": 2_000, "8453": 2_000, "56": 3_000, "137": 2_000, "42161": 250}
DEFAULT_INTERVAL_MS = 12_000
