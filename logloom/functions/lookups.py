"""Code tables of event fields."""

from __future__ import annotations

LEVELS = {"LogAlways": 0, "Critical": 1, "Error": 2, "Warning": 3, "Informational": 4, "Verbose": 5}
KEYWORDS = {
    "None": 0, "ResponseTime": 281474976710656, "WdiContext": 562949953421312, "WdiDiagnostic": 1125899906842624, "Sqm": 2251799813685248,
    "AuditFailure": 4503599627370496, "AuditSuccess": 9007199254740992, "CorrelationHint2": 18014398509481984, "EventLogClassic": 36028797018963968,
}
LOGON_TYPE = {"Interactive": 2, "Network": 3, "Batch": 4, "Service": 5, "Unlock": 7, "NetworkCleartext": 8, "NewCredentials": 9, "RemoteInteractive": 10, "CachedInteractive": 11}
STATUS_CODE = {
    "None": 0x0, "KdcErrNameExp": 0x1, "KdcErrServiceExp": 0x2, "KdcErrBadPvno": 0x3, "KdcErrCOldMastKvno": 0x4, "KdcErrSOldMastKvno": 0x5, "KdcErrCPrincipalUnknown": 0x6,
    "KdcErrSPrincipalUnknown": 0x7, "KdcErrPrincipalNotUnique": 0x8, "KdcErrNullKey": 0x9, "KdcErrCannotPostdate": 0xA, "KdcErrNeverValid": 0xB, "KdcErrPolicy": 0xC,
    "KdcErrBadOption": 0xD, "KdcErrEtypeNotSupp": 0xE, "KdcErrSumtypeNotSupp": 0xF, "KdcErrPadataTypeNotSupp": 0x10, "KdcErrTrtypeNotSupp": 0x11, "KdcErrClientRevoked": 0x12,
    "KdcErrServiceRevoked": 0x13, "KdcErrTgtRevoked": 0x14, "KdcErrClientNotYet": 0x15, "KdcErrServiceNotYet": 0x16, "KdcErrKeyExpired": 0x17, "KdcErrPreauthFailed": 0x18,
    "KdcErrPreauthRequired": 0x19, "KdcErrServerNOMatch": 0x1A, "KdcErrSKeyExpired": 0x1B, "KdcErrAuthExp": 0x1C, "KdcErrPreauthBadIntegrity": 0x1D, "KdcErrAdditionalTickets": 0x1F,
    "StatusNoTrust": 0xC000005E, "StatusLogonFailure": 0xC000006D, "StatusAccountRestriction": 0xC000006E, "StatusInvalidLogonHours": 0xC000006F, "StatusInvalidWorkstation": 0xC0000070,
    "StatusPasswordExpired": 0xC0000071, "StatusAccountDisabled": 0xC0000072, "StatusLogonTypeNotGranted": 0xC000015B, "StatusAccountExpired": 0xC0000193, "StatusAccountLockedOut": 0xC0000234,
}
SUB_STATUS_CODE = {"None": 0x0, "StatusInvalidLogonHours": 0xC000006F, "StatusInvalidWorkstation": 0xC0000070, "StatusPasswordExpired": 0xC0000071, "StatusAccountDisabled": 0xC0000072}
FAILURE_REASON = {"None": 0, "UnknownUserNameOrBadPassword": 2304, "AccountRestrictions": 2305, "AccountExpired": 2306, "AccountLockedOut": 2307, "PasswordExpired": 2308, "LogonTypeNotGranted": 2309}
TICKET_OPTIONS = {
    "Validate": 0x1, "Renew": 0x2, "EncTicketInSessionKey": 0x8, "RenewableOk": 0x10, "Canonicalize": 0x10000, "Anonymous": 0x20000, "OkAsDelegate": 0x40000,
    "TransitPolicyChecked": 0x80000, "HwAuthenticated": 0x100000, "PreAuthenticated": 0x200000, "Initial": 0x400000, "Renewable": 0x800000, "Invalid": 0x1000000, "Postdated": 0x2000000,
    "AllowPostdate": 0x4000000, "Proxy": 0x8000000, "Proxiable": 0x10000000, "Forwarded": 0x20000000, "Forwardable": 0x40000000,
}
TICKET_ENCRYPTION = {
    "DES_CBC_CRC": 0x1, "DES_CBC_MD5": 0x3, "AES128_CTS_HMAC_SHA1_96": 0x11, "AES256_CTS_HMAC_SHA1_96": 0x12, "RC4_HMAC": 0x17, "RC4_HMAC_EXP": 0x18,
    "AES128_CTS_HMAC_SHA256_128": 0x2C, "AES256_CTS_HMAC_SHA384_192": 0x2D, "AuditFailure": 0xFFFFFFFF,
}
WEAK_ENCRYPTION = (0x1, 0x3, 0x17, 0x18)
PRE_AUTH_TYPE = {"None": 0, "EncTimestamp": 2, "PublicKeyInitial": 15, "PublicKeyResponse": 17, "Fast": 136, "EncryptedChallenge": 138}
PRE_AUTH_TEXT = {0: "None", 2: "Password / ENC-TIMESTAMP", 15: "Smartcard / PKINIT", 17: "PKINIT Response", 136: "FAST / Armoring", 138: "Encrypted Challenge"}
IMPERSONATION_LEVEL = {
    "Identification": 1832, "Impersonation": 1833, "Delegation": 1840, "DeniedByProcessTrustLabelACE": 1841, "Yes": 1842, "No": 1843, "System": 1844, "NotAvailable": 1845,
    "Default": 1846, "DisallowMmConfig": 1847, "Off": 1848, "Auto": 1849,
}
VIRTUAL_ACCOUNT = {"Yes": 1843, "No": 1844}
ELEVATED_TOKEN = {"Yes": 1842, "No": 1843}
BITLOCKER_PROTECTOR = {"Tpm": 2200, "ExternalKey": 2201, "NumericalPassword": 2202, "TpmPin": 2203, "TpmStartupKey": 2204, "TpmPinAndStartupKey": 2205, "Passphrase": 2206, "RecoveryKey": 2207}
BITLOCKER_VOLUME = {"OperatingSystemVolume": 810, "FixedDataVolume": 811, "RemovableDataVolume": 812}
NAS_PORT_TYPE = {
    "Async": 0, "Sync": 1, "ISDN": 2, "ISDNV120": 3, "ISDNV110": 4, "Virtual": 5, "PIAFS": 6, "HdlcClearChannel": 7, "X25": 8, "X75": 9,
    "G3Fax": 10, "SDSL": 11, "ADSLCAP": 12, "ADSLDMT": 13, "IDSL": 14, "Ethernet": 15, "XDSL": 16, "Cable": 17, "WirelessOther": 18, "WirelessIEEE80211": 19,
    "TokenRing": 20, "FDDI": 21, "WirelessCDMA": 22, "WirelessCDPD": 23, "WirelessIDEN": 24, "Wireless1XEV": 25, "IAPP": 26, "FTTP": 27,
}
AUTHENTICATION_TYPE = {"Unknown": 0, "PAP": 1, "CHAP": 2, "MSCHAP": 3, "MSCHAPv2": 4, "EAP": 5}
UAC_FLAGS = {
    "SCRIPT": 0x1, "ACCOUNTDISABLE": 0x2, "HOMEDIR_REQUIRED": 0x8, "LOCKOUT": 0x10, "PASSWD_NOTREQD": 0x20, "PASSWD_CANT_CHANGE": 0x40, "ENCRYPTED_TEXT_PWD_ALLOWED": 0x80,
    "TEMP_DUPLICATE_ACCOUNT": 0x100, "NORMAL_ACCOUNT": 0x200, "INTERDOMAIN_TRUST_ACCOUNT": 0x800, "WORKSTATION_TRUST_ACCOUNT": 0x1000, "SERVER_TRUST_ACCOUNT": 0x2000,
    "DONT_EXPIRE_PASSWORD": 0x10000, "MNS_LOGON_ACCOUNT": 0x20000, "SMARTCARD_REQUIRED": 0x40000, "TRUSTED_FOR_DELEGATION": 0x80000, "NOT_DELEGATED": 0x100000, "USE_DES_KEY_ONLY": 0x200000,
    "DONT_REQ_PREAUTH": 0x400000, "PASSWORD_EXPIRED": 0x800000, "TRUSTED_TO_AUTH_FOR_DELEGATION": 0x1000000, "PARTIAL_SECRETS_ACCOUNT": 0x4000000,
}
OPERATION_TYPE = {"%%14674": "Value Added", "%%14675": "Value Deleted", "%%14676": "Unknown"}
VENDORS = {"045E": "Microsoft", "046D": "Logitech", "0781": "SanDisk", "05AC": "Apple", "0BDA": "Realtek"}
KNOWN_LOGS = {
    "Application": "Application", "System": "System", "Security": "Security", "Setup": "Setup", "ForwardedEvents": "ForwardedEvents", "DirectoryService": "Directory Service",
    "DNSServer": "DNS Server", "WindowsPowerShell": "Windows PowerShell",
}
#: Data key of each field that is known by name.
KNOWN_FIELDS = {
    "Message": "Message", "SubjectUserName": "SubjectUserName", "SubjectDomainName": "SubjectDomainName", "SubjectLogonId": "SubjectLogonId", "TargetUserName": "TargetUserName",
    "TargetDomainName": "TargetDomainName", "TargetSid": "TargetSid", "WorkstationName": "WorkstationName", "IpAddress": "IpAddress", "IpPort": "IpPort",
    "LogonType": "LogonType", "Status": "Status", "SubStatus": "SubStatus", "FailureReason": "FailureReason", "AuthenticationPackageName": "AuthenticationPackageName",
    "LogonProcessName": "LogonProcessName", "LmPackageName": "LmPackageName", "KeyLength": "KeyLength", "ProcessId": "ProcessId", "ProcessName": "ProcessName",
    "TransmittedServices": "TransmittedServices", "TicketOptions": "TicketOptions", "TicketEncryptionType": "TicketEncryptionType", "PreAuthType": "PreAuthType", "ClientIp": "ClientIP",
    "HwAddress": "HWAddress", "MacAddress": "MacAddress", "PrivilegeList": "PrivilegeList", "NoNameA0": "NoNameA0", "NoNameA1": "NoNameA1",
    "TextPayload": "#text",
}
PRIVILEGES = {
    "SeAssignPrimaryTokenPrivilege": "Replace a process level token",
    "SeAuditPrivilege": "Generate security audits",
    "SeBackupPrivilege": "Back up files and directories",
    "SeBatchLogonRight": "Log on as a batch job",
    "SeChangeNotifyPrivilege": "Bypass traverse checking",
    "SeCreateGlobalPrivilege": "Create global objects",
    "SeCreatePagefilePrivilege": "Create a pagefile",
    "SeCreatePermanentPrivilege": "Create permanent shared objects",
    "SeCreateSymbolicLinkPrivilege": "Create symbolic links",
    "SeCreateTokenPrivilege": "Create a token object",
    "SeDebugPrivilege": "Debug programs",
    "SeDenyBatchLogonRight": "Deny log on as a batch job",
    "SeDenyInteractiveLogonRight": "Deny log on locally",
    "SeDenyNetworkLogonRight": "Deny access to this computer from the network",
    "SeDenyRemoteInteractiveLogonRight": "Deny log on through Remote Desktop Services",
    "SeDenyServiceLogonRight": "Deny log on as a service",
    "SeEnableDelegationPrivilege": "Enable computer and user accounts to be trusted for delegation",
    "SeImpersonatePrivilege": "Impersonate a client after authentication",
    "SeIncreaseBasePriorityPrivilege": "Increase scheduling priority",
    "SeIncreaseQuotaPrivilege": "Adjust memory quotas for a process",
    "SeIncreaseWorkingSetPrivilege": "Increase a process working set",
    "SeInteractiveLogonRight": "Allow log on locally",
    "SeLoadDriverPrivilege": "Load and unload device drivers",
    "SeLockMemoryPrivilege": "Lock pages in memory",
    "SeMachineAccountPrivilege": "Add workstations to domain",
    "SeManageVolumePrivilege": "Perform volume maintenance tasks",
    "SeNetworkLogonRight": "Access this computer from the network",
    "SeProfileSingleProcessPrivilege": "Profile single process",
    "SeRelabelPrivilege": "Modify an object label",
    "SeRemoteInteractiveLogonRight": "Allow log on through Remote Desktop Services",
    "SeRemoteShutdownPrivilege": "Force shutdown from a remote system",
    "SeRestorePrivilege": "Restore files and directories",
    "SeSecurityPrivilege": "Manage auditing and security log",
    "SeServiceLogonRight": "Log on as a service",
    "SeShutdownPrivilege": "Shut down the system",
    "SeSyncAgentPrivilege": "Synchronize directory service data",
    "SeSystemEnvironmentPrivilege": "Modify firmware environment values",
    "SeSystemProfilePrivilege": "Profile system performance",
    "SeSystemtimePrivilege": "Change the system time",
    "SeTakeOwnershipPrivilege": "Take ownership of files or other objects",
    "SeTcbPrivilege": "Act as part of the operating system",
    "SeTimeZonePrivilege": "Change the time zone",
    "SeTrustedCredManAccessPrivilege": "Access Credential Manager as a trusted caller",
    "SeUndockPrivilege": "Remove computer from docking station",
}
