"""The trace schema: one row a packet, in microseconds and unsigned values held in wider signed types."""

from pyspark.sql import types as T

TRACE = T.StructType([
    T.StructField("rec_no", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
    T.StructField("sport", T.IntegerType()), T.StructField("dport", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("proto", T.IntegerType()), T.StructField("flags", T.IntegerType()),
])
SYN, ACK, FIN, RST, SYNTHETIC, IPV6 = 1, 2, 4, 8, 16, 32
ICMP, TCP, UDP = 1, 6, 17
TUPLE = ("src", "dst", "sport", "dport", "proto")
#: relations that are read from files
QUERY = "win long, tau_us long, t_rel_s double, key string, N long, threshold long, exact_f long, exact_hh int, exact_delta long"
