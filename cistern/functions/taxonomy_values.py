"""Error classes, their patterns, and the order that settles ties."""

# Taxonomy applied to the trace of every failed job.
VERSION = "0.0.0-dev"

CLASSES = {
    "network_timeout": ["socket.timeout", r"curl: \(28\)", "The read operation timed out"],
    "network_error": [
        r"curl: \(22\)",
        "HTTP Error 404",
        r"curl: \(60\)",
        "ConnectionResetError:",
        "curl.+SSL_ERROR_SYSCALL",
        r"Job failed \(system failure\):.+TLS handshake timeout",
        r"curl: \(6\) Could not resolve host",
    ],
    "dns_error": ["could not resolve host"],
    "concretization_error": [
        "does not satisfy",
        "Error: errors occurred during concretization",
        "Error: concretization failed for the following reasons",
        "Spack concretizer internal error.",
        "failed to concretize .+ for the following reasons",
        "variant .+ not found in package",
        "trying to set variant .+ in package .+, but the package has no such variant",
        "No such variant .+ for spec",
        "UnknownVariantError",
        "Spec version is not concrete",
        "UnsatisfiableSpecError",
        "cannot have a dependency on",
    ],
    "job_log_missing": ["ERROR: Got [0-9][0-9][0-9] for", "ERROR: Log File Empty"],
    "limit_exceeded": ["Job's log exceeded limit of"],
    "execution_timeout": ["ERROR: Job failed: execution took longer than"],
    "5XX": ["HTTP Error 5[00|02|03]"],
    "spack_root": ["Error: SPACK_ROOT"],
    "setup_env": ["setup-env.sh: No such file or directory"],
    "no_spec": ["SpackError: No installed spec matches the hash"],
    "failed_to_get_specs": [
        "Error: Unable to generate package index: Failed to get list of entries from"
    ],
    "build_error": ["error found in build log:", "errors found in build log:"],
    "oom": ["command terminated with exit code 137", "ERROR: Job failed: exit code 137"],
    "aws_access_denied": [
        "The AWS Access Key Id you provided does not exist in our records",
        "An error occurred (AccessDenied)",
    ],
    "gitlab_down": ["fatal: unable to access 'https://gitlab.spack.io"],
    "github_down": ["fatal: unable to access 'https://github.com"],
    "no_space": ["No space left on device"],
    "module_not_found": ["ModuleNotFoundError: No module named"],
    "artifacts": ["ERROR: Uploading artifacts", "ERROR: Downloading artifacts"],
    "fatal": ["FATAL: invalid argument"],
    "dial_backend": ["error dialing backend"],
    "spot_reclamation": [
        "node no longer exists",
        "Pod was terminated in response to imminent node shutdown",
    ],
    "pod_cleanup": ["Error cleaning up pod"],
    "pod_exec": ["Error response from daemon: No such exec instance"],
    "cmd_not_found": ["Command exited with status 127"],
    "db_match": ["Error: Expected database version", "spack.store.MatchError:"],
    "pod_timeout": [
        "timed out waiting for pod to start",
        "ERROR: Job failed (system failure): prepare environment: Timeout occurred.",
    ],
    "pod_not_found": [r"ERROR: Job failed \(system failure\):.+pods .+ not found"],
    "pod_failed": ['ERROR: Job failed.*:.*pod.+status is ("Failed"|failed)'],
    "pod_invalid": ["Pod.+is invalid"],
    "helper_container_not_found": [
        "ERROR: Job failed.+:.+container helper not found in pod",
        r'container not found \("helper"\)',
    ],
    "docker_daemon": ["Cannot connect to the Docker daemon"],
    "docker_format": ["exec /usr/bin/sh: exec format error"],
    "rpc_failure": ["error: RPC failed"],
    "write_lock_timeout": ["Timed out waiting for a write lock"],
    "reloc_path_too_long": [
        "Error: Failed to install.+due to CannotGrowString: Cannot replace.+"
        "To fix this, compile with more padding"
    ],
    "spack_error": [
        "To reproduce this build locally, run:",
        "Error: No version for .+ satisfies",
        "Error: errors occurred during concretization of the environment",
        "cannot load package .+ from the .builtin. repository",
        "must have a default provider in /builds/spack/spack/etc/spack/defaults/packages.yaml",
        "Error: .+ object has no attribute",
        "Error: module .+ has no attribute",
        "spack.error.InstallError",
        r"Traceback \(most recent call last\):[\S\n\t\v ]+AssertionError",
        "ConfigFormatError",
        "KeyError: VersionBase",
    ],
    "invalid_pipeline_yaml": ["Error:.+ is not valid under any of the given schemas"],
    "file_not_found": ["No such file or directory"],
    "ref_not_found": ["fatal: Remote branch", "fatal: couldn.t find remote ref"],
    "pipeline_generation": [
        "Error: Pipeline generation failed",
        "RuntimeError: cannot emit requirements for the solver:",
        "SpackEnvironmentConfigError: Invalid environment configuration",
    ],
    "killed": ["Killed"],
    "remote_disconnect": ["http.client.RemoteDisconnected"],
    "db_hash": ["Error: Expected database index keyed by"],
    "image_pull": [
        "ERROR: Job failed: failed to pull image",
        "ERROR: Job failed.+image pull failed",
        r"ERROR: Job failed \(system failure\): failed to pull image",
        "image pull failed: Back-off pulling image",
    ],
    "no_binary_for_spec": [
        "Error: No binary found when cache-only was specified",
        "no binary available",
    ],
    "deprecated_stack_bug": ["Error: Mirror with name mirror_override already exists."],
    "checksum_mismatch": ["Error: sha256 checksum failed for .+"],
    "sha256sum_not_found": ["sha256sum: command not found"],
    "unallowed_image": ["The.+image is not present on list of allowed images"],
    "aborted_terminated": [r"ERROR: Job failed \(system failure\): aborted: terminated"],
    "gpg_fail_open_files": ["gpg: can't open '/tmp/*'"],
    "gpg_no_valid_ids": ["gpg: key.+: no valid user IDs"],
    "nvidia_detection_error": ["nvidia-container-cli: detection error: nvml error"],
    "bootstrap_patchelf_failure": ["Error: cannot bootstrap any of the patchelf executables"],
    "oidc_certificate_expired": [
        "OpenIDConnect provider's HTTPS certificate doesn't match configured thumbprint"
    ],
    "stuck_or_timeout_failure": None,
    "scheduler_failure": None,
}

ORDER = [
    "oidc_certificate_expired",
    "dns_error",
    "network_timeout",
    "network_error",
    "job_log_missing",
    "no_space",
    "invalid_pipeline_yaml",
    "checksum_mismatch",
    "concretization_error",
    "no_binary_for_spec",
    "db_match",
    "db_hash",
    "no_spec",
    "failed_to_get_specs",
    "ref_not_found",
    "cmd_not_found",
    "module_not_found",
    "setup_env",
    "spack_root",
    "write_lock_timeout",
    "reloc_path_too_long",
    "build_error",
    "spack_error",
    "pipeline_generation",
    "killed",
    "deprecated_stack_bug",
    "aborted_terminated",
    "bootstrap_patchelf_failure",
    "oom",
    "gitlab_down",
    "github_down",
    "artifacts",
    "fatal",
    "pod_exec",
    "pod_timeout",
    "spot_reclamation",
    "pod_cleanup",
    "pod_not_found",
    "pod_failed",
    "pod_invalid",
    "helper_container_not_found",
    "image_pull",
    "docker_daemon",
    "docker_format",
    "rpc_failure",
    "dial_backend",
    "remote_disconnect",
    "aws_access_denied",
    "nvidia_detection_error",
    "execution_timeout",
    "5XX",
    "gpg_fail_open_files",
    "gpg_no_valid_ids",
    "unallowed_image",
    "limit_exceeded",
    "sha256sum_not_found",
    "file_not_found",
]

# Taxonomy of the error export, written as grep basic regular expressions.
EXPORT_CLASSES = {
    "job_log_missing": ["ERROR: Got [0-9][0-9][0-9] for", "ERROR: Log File Empty"],
    "limit_exceeded": ["Job's log exceeded limit of"],
    "execution_timeout": ["ERROR: Job failed: execution took longer than"],
    "5XX": ["HTTP Error 5[00|02|03]"],
    "spack_root": ["Error: SPACK_ROOT"],
    "setup_env": ["setup-env.sh: No such file or directory"],
    "no_spec": ["SpackError: No installed spec matches the hash"],
    "build_error": ["error found in build log:", "errors found in build log:"],
    "oom": ["command terminated with exit code 137", "ERROR: Job failed: exit code 137"],
    "gitlab_down": ["fatal: unable to access"],
    "module_not_found": ["ModuleNotFoundError: No module named"],
    "artifacts": ["ERROR: Uploading artifacts", "ERROR: Downloading artifacts"],
    "fatal": ["FATAL: invalid argument"],
    "dial_backend": ["error dialing backend"],
    "pod_cleanup": ["Error cleaning up pod"],
    "pod_exec": ["Error response from daemon: No such exec instance"],
    "cmd_not_found": ["Command exited with status 127"],
    "db_mismatch": ["Error: Expected database version"],
    "db_match": ["spack.store.MatchError:"],
    "pod_timeout": ["timed out waiting for pod to start"],
    "docker_daemon": ["Cannot connect to the Docker daemon"],
    "rcp_failure": ["error: RPC failed"],
    "spack_error": ["To reproduce this build locally, run:"],
    "remote_not_found": ["fatal: Remote branch", "fatal: couldn't find remote ref"],
    "pipeline_generation": ["Error: Pipeline generation failed"],
    "killed": ["Killed"],
    "remote_disconnect": ["http.client.RemoteDisconnected"],
    "db_hash": ["Error: Expected database index keyed by"],
    "image_pull": [
        "Job failed (system failure): prepare environment: image pull failed",
        "ERROR: Job failed (system failure): failed to pull image",
    ],
}

EXPORT_ORDER = [
    "job_log_missing",
    "oom",
    "gitlab_down",
    "artifacts",
    "fatal",
    "pod_exec",
    "pod_timeout",
    "pod_cleanup",
    "image_pull",
    "docker_daemon",
    "rcp_failure",
    "5XX",
    "dial_backend",
    "remote_disconnect",
    "db_mismatch",
    "db_match",
    "db_hash",
    "no_spec",
    "remote_not_found",
    "cmd_not_found",
    "module_not_found",
    "setup_env",
    "spack_root",
    "build_error",
    "spack_error",
    "pipeline_generation",
    "killed",
    "limit_exceeded",
    "execution_timeout",
    "other_errors",
]
