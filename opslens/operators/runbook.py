"""Checks by hand that would settle a hypothesis: a table of rules joined by fault mode, and two that depend on the hypothesis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Checks of fault modes (modes, check, title, priority, evidence, reason, hint), in order; {endpoint} stands for what the log names.
CHECKS = (
    (("REDIS_TIMEOUT",), "redis_latency", "确认 Redis 是否存在高延迟或慢命令", "high", "redis_health", "当前日志能证明 Redis 依赖超时，但不能区分 Redis 慢、网络慢或客户端连接池耗尽。", "redis-cli --latency；redis-cli SLOWLOG GET 20；检查 Redis INFO commandstats/latencystats"),
    (("REDIS_TIMEOUT",), "client_pool_exhaustion", "检查调用方 Redis 连接池和线程池是否耗尽", "high", "client_runtime", "超时可能发生在调用方排队、连接池不足或线程池阻塞阶段。", "检查应用 Hikari/Lettuce/Jedis pool 指标、线程池队列、GC pause 和超时配置"),
    (("REDIS_TIMEOUT",), "network_path_latency", "检查服务到 Redis 的网络延迟和丢包", "medium", "network", "拓扑链路显示故障可能沿依赖路径传播，需要确认链路本身是否异常。", "从调用方节点执行 ping/mtr/tcping 到 Redis endpoint，并核对同时间段网络监控"),
    (("REDIS_UNREACHABLE",), "redis_endpoint_reachability", "确认目标 Redis endpoint 是否可连接", "high", "endpoint_reachability", "日志包含连接不可达/拒绝信号，应优先验证目标实例或集群入口是否仍在监听。", "redis-cli -h <host> -p <port> PING；nc -vz <host> <port>{endpoint}"),
    (("REDIS_UNREACHABLE",), "redis_cluster_state", "检查 Redis Sentinel/Cluster 和实例进程状态", "high", "redis_health", "连接被拒绝可能来自实例宕机、主从切换、槽位迁移或服务端口未监听。", "redis-cli CLUSTER INFO；redis-cli SENTINEL masters；systemctl/docker/kubectl 查看实例状态"),
    (("DATABASE_FAILURE", "DATABASE_UNREACHABLE"), "database_connectivity", "确认数据库 endpoint、连接数和慢查询状态", "high", "database_health", "数据库类异常需要区分不可达、连接池耗尽、锁等待和慢查询。", "检查 DB 连接数、slow query、lock wait、主从延迟和应用连接池指标"),
    (("MESSAGE_BROKER_FAILURE",), "broker_health", "确认消息中间件 broker、分区和消费积压状态", "high", "broker_health", "消息中间件异常需要核查 broker 可用性、队列积压和客户端连接状态。", "检查 Kafka/RabbitMQ/RocketMQ broker 状态、consumer lag、连接数和错误日志"),
    (("DEPENDENCY_FAILURE",), "dependency_reachability", "确认下游依赖的健康状态和网络连通性", "high", "dependency_health", "日志只暴露通用超时/连接异常，需要沿图谱链路逐跳确认依赖是否可用。", "按 RCA 链路从调用方到候选依赖逐跳执行健康检查、端口连通性和错误日志核对"),
    (("JVM_OOM",), "jvm_heap_dump", "获取 JVM 堆转储（Heap Dump）并分析内存泄漏", "high", "jvm_memory", "OOM 需要通过 heap dump 定位泄漏对象；同时检查 JVM -Xmx 是否过低。", "jmap -dump:format=b,file=heap.hprof <pid>；检查 JVM -Xmx/-Xms 参数；核对近期大对象缓存变更"),
    (("JVM_OOM",), "gc_log_analysis", "分析 GC 日志，确认 Full GC 频率和停顿时长", "high", "jvm_gc", "OOM 通常伴随频繁 Full GC，GC 日志能还原内存压力历史。", "开启 -Xlog:gc*；查看 GC 时间线；核对 GC 停顿是否与业务高峰重叠"),
    (("DB_DEADLOCK", "DB_LOCK_TIMEOUT"), "db_lock_analysis", "分析数据库锁等待链和死锁日志", "high", "database_lock", "死锁/锁超时需要从数据库侧获取锁等待链，才能确认涉及的事务和 SQL。", "SHOW ENGINE INNODB STATUS；SELECT * FROM information_schema.INNODB_LOCKS；核对高并发写入路径"),
    (("DB_POOL_EXHAUSTED",), "db_pool_config", "检查 HikariCP 连接池配置和当前连接数", "high", "database_pool", "连接池耗尽可能由配置过小、连接泄漏或数据库响应慢引起。", "核对 maximumPoolSize/connectionTimeout；SHOW PROCESSLIST；检查慢 SQL"),
    (("DISK_IO_FAILURE",), "disk_health_check", "检查宿主机磁盘健康状态和文件系统挂载模式", "high", "disk_health", "只读文件系统通常由磁盘 I/O 错误触发内核自动保护切换导致，需优先确认磁盘是否物理损坏。", "dmesg | grep -i 'error\\|i/o\\|readonly'；smartctl -a /dev/sda；mount | grep ro"),
    (("CPU_OVERLOAD",), "cpu_load_analysis", "分析宿主机 CPU 负载来源（进程/线程/内核）", "high", "cpu_health", "CPU 100% 可能由 JVM GC、热点代码、外部流量突增或 D 状态进程引起，需线程粒度分析。", "top -H（线程粒度）；perf top；jstack <pid>；核对 D 状态进程"),
    (("CPU_OVERLOAD",), "cpu_resource_quota", "确认容器 CPU limit（cgroup）是否正确设置", "medium", "resource_quota", "容器 CPU limit 缺失时单个 Pod 可能耗尽宿主机全部算力，影响同宿主机其他服务。", "kubectl describe pod <pod>；cat /sys/fs/cgroup/cpu/cpu.cfs_quota_us"),
    (("NETWORK_FAILURE",), "nic_status_check", "确认宿主机网卡状态和物理链路", "high", "network_hardware", "NIC link down 表示物理层断连，需先恢复硬件链路再处理上层服务恢复。", "ip link show；ethtool <eth0>；核对交换机端口状态和光模块告警"),
    (("NETWORK_FAILURE",), "pod_migration", "将受影响 Pod 迁移到健康宿主机", "high", "failover", "硬件故障期间快速迁移是恢复服务的最短路径，同时隔离故障节点。", "kubectl drain <node> --ignore-daemonsets；kubectl cordon <node>；确认 Pod 重调度情况"),
    (("AUTH_FAILURE",), "token_expiry_check", "确认 OAuth2 Token 有效期和签名密钥配置", "high", "auth_config", "HTTP 401 通常由 Token 过期、签名密钥不匹配或证书轮换后配置未同步引起。", "核对 security-service 密钥配置；检查各服务 Token 有效期设置；确认 NTP 时钟同步"),
    (("CIRCUIT_BREAKER_OPEN",), "circuit_breaker_state", "确认熔断器状态和触发阈值配置", "high", "circuit_breaker", "熔断器打开说明下游错误率超过阈值；需先定位并修复下游服务的真实故障。", "查看 Hystrix Dashboard / Resilience4j metrics；核对 failureRateThreshold；确认下游服务状态"),
)
# The check of any other mode, of a hypothesis that names no machine, and of one with a chain; the kinds that need a machine.
OTHER = ("application_error_context", "补充应用异常上下文和近期变更信息", "medium", "application_context", "当前异常尚未识别为明确的基础设施依赖故障，需要先确认代码、配置或发布变更。", "核对同时间段发布记录、配置变更、应用 ERROR 日志、线程栈和业务错误码")
IDENTITY = ("endpoint_identity", "补充候选组件的具体 host/IP/port 或实例健康证据", "high", "endpoint_identity", "当前候选还停留在组件/集群级，缺少能确认具体实例的直接标识。", "在架构图 meta 中补充 host/ip/port/endpoints，并核对日志是否出现目标 endpoint")
CHAIN = ("propagation_chain_check", "沿 RCA 链路核对上游是否为传播影响", "medium", "topology_propagation", "需要确认链路上游错误是由候选根因传播导致，而不是独立故障。", "按链路顺序核对 trace、时间线、调用错误码和上游服务健康状态")
VAGUE_KINDS, VAGUE_EVIDENCE = ("Cluster", "Cache", "Database", "Middleware", "Queue"), "host/IP/port"
SAID = "；日志命中 {}"

_FIELDS = ("check_id", "title", "priority", "evidence_type", "reason", "hint")


def _check(values):
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(_FIELDS, values)))


def _by_mode():
    """Each mode's checks, as a map literal: it is a part of the plan, so nothing is joined or shuffled."""
    modes = dict.fromkeys(m for row in CHECKS for m in row[0])
    return F.create_map(*(x for m in modes for x in (F.lit(m), F.array(*(_check(row[1:]) for row in CHECKS if m in row[0])))))


def suggested_checks(hypotheses: DataFrame) -> DataFrame:
    """incident, rank, place, check_id, title, priority, target, target_kind, mode, evidence_type, reason, hint, chain: checks of
    hypotheses (incident, rank, node, kind, mode, endpoint, chain and missing: arrays), in order from 1.

    A null or unknown mode has the check of any other; null endpoints, chains and lists of missing evidence count as empty."""
    given = F.coalesce("endpoint", F.lit(""))
    own = F.coalesce(F.try_element_at(_by_mode(), F.coalesce("mode", F.lit(""))), F.array(_check(OTHER)))
    said = F.when(given != "", F.concat(F.lit(SAID.split("{}")[0]), given)).otherwise(F.lit(""))
    own = F.transform(own, lambda c: c.withField("hint", F.replace(c["hint"], F.lit("{endpoint}"), said)))
    lacks = F.exists(F.coalesce("missing", F.array().cast("array<string>")), lambda m: F.coalesce(F.contains(m, F.lit(VAGUE_EVIDENCE)), F.lit(False)))
    vague = (given == "") & (F.coalesce(F.col("kind").isin(*VAGUE_KINDS), F.lit(False)) | lacks)
    linked = F.coalesce(F.size("chain") > 1, F.lit(False))
    more = F.array_compact(F.array(F.when(vague, _check(IDENTITY)), F.when(linked, _check(CHAIN))))
    rows = hypotheses.select("incident", "rank", "node", "kind", "mode", "chain", F.posexplode(F.concat(own, more)).alias("place", "c"))
    return rows.select("incident", "rank", (F.col("place") + 1).alias("place"), "c.check_id", "c.title", "c.priority", F.col("node").alias("target"), F.col("kind").alias("target_kind"), "mode", "c.evidence_type", "c.reason", "c.hint", "chain")
