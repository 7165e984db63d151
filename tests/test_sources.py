import socket
import threading
import time

from pyspark.sql import functions as F

from riffle.functions.parsing import rtp_fields
from riffle.plans.packet_queries import ts_stream
from riffle.sources.files import joined, transport_packets, whole_files, write_bytes
from riffle.sources.rtp import RtpPort

SF = "/root/testdata/sf0.001"


def test_transport_files_round_trip(spark, tmp_path):
    rows = ts_stream(spark, SF).where("doc_id < 20")
    files = joined(rows, "doc_id", "seq", "packet").withColumn("name", F.concat("name", F.lit(".ts")))
    write_bytes(files, str(tmp_path / "ts"))
    read = transport_packets(spark, str(tmp_path / "ts"))
    assert read.count() == rows.count() and read.where("err IS NOT NULL").count() == 0
    assert read.where("pusi").count() == 20 and whole_files(spark, str(tmp_path / "ts")).count() == 20


def test_packets_from_a_port(spark, tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    spark.dataSource.register(RtpPort)
    stop = threading.Event()

    def send():
        out, i = socket.socket(socket.AF_INET, socket.SOCK_DGRAM), 0
        while not stop.is_set():
            out.sendto(bytes.fromhex("8060") + i.to_bytes(2, "big") + bytes(8) + b"media", ("127.0.0.1", port))
            i += 1
            time.sleep(0.02)

    sender = threading.Thread(target=send)
    sender.start()
    packets = spark.readStream.format("rtp_port").option("port", port).option("wait", "0.005").load()
    q = packets.select("n", rtp_fields(F.col("packet"))["seq"].alias("seq")).writeStream.format("memory").queryName("rtp_port_test").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("rtp_port_test").count() < 5:
            time.sleep(0.5)
    finally:
        q.stop()
        stop.set()
        sender.join()
    got = [r.seq for r in spark.table("rtp_port_test").orderBy("n").collect()]
    assert len(got) >= 5 and got == sorted(got)
