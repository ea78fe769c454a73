"""Fixed name sets that decide how a call is read."""

# Call families.
OPEN_CALLS = ["open", "openat", "creat"]
READ_CALLS = ["read", "pread64", "readv", "preadv"]
WRITE_CALLS = ["write", "pwrite64", "writev", "pwritev"]
FORK_CALLS = ["clone", "clone3", "fork", "vfork"]
EXEC_CALLS = ["execve", "execveat"]
POLL_CALLS = ["poll", "ppoll", "select", "pselect6", "epoll_wait", "epoll_pwait"]
IN_PROGRESS = ["EINPROGRESS", "EALREADY"]

# Calls that take a path (first quoted string) or a descriptor (first integer), per log kind.
SYSCALL_LOG_PATH_CALLS = [
    "open", "openat", "creat", "stat", "lstat", "newfstatat", "statx", "access", "faccessat", "unlink", "unlinkat",
    "mkdir", "mkdirat", "rmdir", "rename", "renameat", "renameat2", "readlink", "readlinkat", "execve", "execveat",
    "chdir", "truncate", "chmod", "chown",
]
SYSCALL_LOG_FD_CALLS = [
    "read", "write", "pread64", "pwrite64", "readv", "writev", "close", "fstat", "fsync", "fdatasync", "lseek",
    "ioctl", "fcntl", "dup", "dup2", "dup3", "sendto", "recvfrom", "send", "recv", "epoll_wait", "epoll_ctl",
    "getdents64", "fchdir", "ftruncate", "mmap",
]
LIBRARY_LOG_PATH_CALLS = [
    "open", "openat", "creat", "stat", "lstat", "newfstatat", "statx", "access", "faccessat", "unlink", "unlinkat",
    "execve", "execveat",
]
LIBRARY_LOG_FD_CALLS = [
    "read", "write", "pread64", "pwrite64", "readv", "writev", "close", "fstat", "fsync", "lseek", "ioctl", "fcntl",
    "sendto", "recvfrom",
]

# Allocator functions.
ALLOC_FUNCS = ["malloc", "calloc", "realloc", "reallocarray", "valloc", "aligned_alloc", "memalign", "pvalloc"]
FREE_FUNCS = ["free", "cfree"]

# Path fragments that mark loader traffic and start-up probing.
LIBRARY_HINTS = [".so", "/lib/", "/lib64/", "/usr/lib", "/etc/ld.so"]
PROBE_HINTS = LIBRARY_HINTS + [
    ".pyc", "__pycache__", "site-packages", "dist-packages", ".egg", ".dist-info", "node_modules", "/proc/", "/sys/",
    "/dev/", "/usr/share/locale", "/gconv/", "/etc/os-release", "/etc/lsb-release", ".terminfo", "/run/", "/var/run/",
    "/bin/", "/sbin/", "/.local/", "/.npm-global/", "/.config/", "/.cache/", "pyvenv.cfg", "._pth", "pybuilddir",
    "Setup.local", "/.git/",
]
CURATION_LIBRARY_HINTS = [".so", "/lib/", "/usr/lib", "/etc/ld.so"]

# Severities, most severe first, and the score each starts from.
SEVERITIES = ["critical", "high", "medium", "low", "clean"]
SEVERITY_BASE = {"critical": 90.0, "high": 70.0, "medium": 45.0, "low": 20.0}
LIVE_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}

# Why a thread was off the CPU, by the code the probe prints.
OFF_REASON_CODES = {0: "other", 1: "net", 3: "lock", 4: "sleep", 5: "disk"}
OFF_REASONS = ["net", "lock", "sleep", "disk", "other"]

# Histogram units in milliseconds.
UNIT_MS = {"msecs": 1.0, "usecs": 1e-3, "nsecs": 1e-6, "secs": 1000.0}
