"""Named events: a registry of declarative rules, and their dispatch as one projection.

A rule is a channel, event ids, a predicate and columns. Columns are given in a small notation:

    C A W T          computer, action (message subject), who (subject account), when
    Name             the event-data value of that key
    Name=Key         ... of another key
    Name=join:a|b    two keys joined (both: a\\b; one: it)
    Name=pick:a|b|c  the first key that is not blank
    Name=kind:Key    a decoder of KINDS, of a key or of join: / pick:
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import decode as D, lookups as L
from ..functions.parse import account, joined, lookup, raw

DATA = "data_ci"


def _enum(table: dict[str, int], base: str = "auto") -> Callable[[Column], Column]:
    return lambda c: D.enum_name(D.decode_enum(c, table, base), table)


KINDS: dict[str, Callable[[Column], Column]] = {
    "optype": D.operation_type, "ip": D.normalize_ip, "uac": D.decode_uac, "trim": F.trim, "int": D.first_int, "hex": D.hex_ascii, "gpolinks": D.gpo_links, "kerberos": D.kerberos_policy,
    "bind": D.bind_type, "auth": D.authentication_type, "device": D.translate_device, "vendor": D.translate_vendor,
    "words": lambda c: F.split(F.trim(c), r"\s+"), "privileges": lambda c: F.transform(F.split(F.trim(c), r"\s+"), D.translate_privilege),
    "logon": _enum(L.LOGON_TYPE, "decimal"), "status": _enum(L.STATUS_CODE, "hexadecimal"), "substatus": _enum(L.SUB_STATUS_CODE, "hexadecimal"), "reason": _enum(L.FAILURE_REASON, "decimal"),
    "impersonation": _enum(L.IMPERSONATION_LEVEL), "virtual": _enum(L.VIRTUAL_ACCOUNT), "elevated": _enum(L.ELEVATED_TOKEN), "encryption": _enum(L.TICKET_ENCRYPTION), "nasport": _enum(L.NAS_PORT_TYPE),
    "volume": _enum(L.BITLOCKER_VOLUME), "protector": _enum(L.BITLOCKER_PROTECTOR),
    "statustext": lambda c: D.describe_status(D.decode_enum(c, L.STATUS_CODE, "hexadecimal"), c), "optionstext": lambda c: D.describe_options(D.decode_enum(c, L.TICKET_OPTIONS, "hexadecimal"), c),
    "encryptiontext": lambda c: D.describe_encryption(D.decode_enum(c, L.TICKET_ENCRYPTION), c), "preauthtext": lambda c: D.describe_pre_auth(D.decode_enum(c, L.PRE_AUTH_TYPE), c),
    "weak": lambda c: F.coalesce(D.decode_enum(c, L.TICKET_ENCRYPTION).isin(*L.WEAK_ENCRYPTION), F.lit(False)),
    "unusual": lambda c: F.coalesce(D.parse_unsigned(c, "hexadecimal") != 0x40810010, F.lit(False)),
}
HEADS = {
    "C": lambda: F.col("computer_name").alias("Computer"), "A": lambda: F.col("message_subject").alias("Action"),
    "W": lambda: account(F.col(DATA), "Subject").alias("Who"), "T": lambda: F.col("time_created").alias("When"),
}


def source_column(text: str) -> Column:
    data = F.col(DATA)
    if text.startswith("join:"):
        a, b = text[5:].split("|")
        return joined(raw(data, a), raw(data, b))
    if text.startswith("pick:"):
        return D.first_filled(*[raw(data, k) for k in text[5:].split("|")])
    if text in ("target", "subject"):
        return account(data, text.title())
    kind, _, rest = text.partition(":")
    if rest and kind in KINDS:
        return KINDS[kind](source_column(rest))
    return lookup(data, text)


def makers_of(notation: str) -> dict[str, Callable[[], Column]]:
    """Name -> maker of a column; making one is some dozens of calls to the engine, so callers make what they select."""
    out: dict[str, Callable[[], Column]] = {}
    for part in notation.split(";"):
        part = part.strip()
        if part in HEADS:
            out[{"C": "Computer", "A": "Action", "W": "Who", "T": "When"}[part]] = HEADS[part]
        elif part:
            name, _, text = part.partition("=")
            out[name] = lambda text=text or name: source_column(text)
    return out


@dataclass(frozen=True)
class RuleSpec:
    name: str
    channel: str
    ids: tuple[int, ...]
    notation: str
    predicate: Callable[[], Column] | None = None
    extra: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def guard(self) -> Column:
        """Channel, ids and predicate: an event of another rule never passes."""
        ids = F.col("id").isin(*self.ids) if len(self.ids) > 1 else F.col("id") == self.ids[0]
        base = (F.col("log_name") == self.channel) & ids
        return base & F.coalesce(self.predicate(), F.lit(False)) if self.predicate else base

    def makers(self) -> dict[str, Callable[[], Column]]:
        return makers_of(self.notation) | self.extra

    def columns(self) -> dict[str, Column]:
        return {k: f() for k, f in self.makers().items()}


RULES: dict[str, RuleSpec] = {}


def register_rule(rule: RuleSpec, replace: bool = False) -> RuleSpec:
    if rule.name in RULES and not replace:
        raise ValueError(f"rule {rule.name} exists")
    RULES[rule.name] = rule
    return rule


def provider(*names: str) -> Callable[[], Column]:
    return lambda: F.upper("provider_name").isin(*[n.upper() for n in names])


def value_is(key: str, *values: str) -> Callable[[], Column]:
    """A data value is one of the given ones, without case."""
    return lambda: F.upper(raw(F.col(DATA), key)).isin(*[v.upper() for v in values])


def every(*predicates: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: reduce(lambda a, b: a & b, [p() for p in predicates])


def either(*predicates: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), [p() for p in predicates])


def missing_or_not(key: str, *values: str) -> Callable[[], Column]:
    return lambda: raw(F.col(DATA), key).isNull() | ~F.upper(raw(F.col(DATA), key)).isin(*[v.upper() for v in values])


def text_has(column: str, *words: str) -> Callable[[], Column]:
    return lambda: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(w)) for w in words])


def found(pattern: str, column: str = "message", group: int = 1) -> Callable[[], Column]:
    return lambda: F.trim(F.regexp_extract(F.coalesce(column, F.lit("")), pattern, group))


def filled(text: str, *more: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: D.first_filled(source_column(text), *[m() for m in more])


def _moved(target: str, source_key: str) -> Callable[[], Column]:
    """Where the object was moved, its new place instead of the field's own value."""
    moved = "A directory service object was moved."
    return lambda: D.overwrite_by_field(F.col("message_subject"), moved, source_column(target), source_column(source_key))


def _longest() -> Column:
    data = F.col(DATA)
    return D.longest_text(F.col("message_subject"), F.col("message"), raw(data, "NoNameA0"), raw(data, "#text"))


def _os_time() -> Column:
    data = F.col(DATA)
    unlabeled = D.unlabeled_timestamp(raw(data, "NoNameA1"), raw(data, "NoNameA0"))
    return F.coalesce(unlabeled, D.parse_utc(raw(data, "StartTime")), F.col("time_created").cast("timestamp"))


def _rule(name: str, channel: str, ids: str | tuple[int, ...], notation: str, predicate=None, **extra) -> None:
    numbers = tuple(int(x) for x in ids.split()) if isinstance(ids, str) else ids
    register_rule(RuleSpec(name, channel, numbers, notation, predicate, extra))


#: Fixed names of channels and providers.
SECURITY, SYSTEM, APPLICATION = "Security", "System", "Application"
AUDITING = "Microsoft-Windows-Security-Auditing"
EVENT_LOG = ("EventLog", "Microsoft-Windows-Eventlog")
DIRECTORY_IDS = "5136 5137 5139 5141"
CHANGE = "OperationType=optype:OperationType;FieldChanged=AttributeLDAPDisplayName"
ACCOUNT_FIELDS = """SamAccountName;DisplayName;UserPrincipalName;HomeDirectory;HomePath;ScriptPath;ProfilePath;UserWorkstations;PasswordLastSet;AccountExpires;PrimaryGroupId;AllowedToDelegateTo;
OldUacValue=uac:OldUacValue;NewUacValue=uac:NewUacValue;UserAccountControl=uac:UserAccountControl;UserParameters;SidHistory;LogonHours"""
LOGON = "C;A;W;T;IpAddress;IpPort;LogonProcessName;ImpersonationLevel=impersonation:ImpersonationLevel;VirtualAccount=virtual:VirtualAccount;ElevatedToken=elevated:ElevatedToken;ObjectAffected=target;LogonType=logon:LogonType"

_rule("AADConnectRunProfile", APPLICATION, "906", "T;Connector=join:Connector|Connector Name;RunProfile=join:RunProfileName|Run Profile Name")
_rule("ADComputerChangeDetailed", SECURITY, DIRECTORY_IDS, f"C;A;W;T;ObjectClass;{CHANGE}", value_is("ObjectClass", "computer"), ComputerObject=_moved("ObjectDN", "OldObjectDN"), FieldValue=_moved("AttributeValue", "NewObjectDN"))
_rule("ADComputerCreateChange", SECURITY, "4741 4742", f"C;A;W;T;ComputerAffected=target;{ACCOUNT_FIELDS};DnsHostName;ServicePrincipalNames")
_rule("ADComputerDeleted", SECURITY, "4743", "C;A;W;T;ComputerAffected=target")
_rule("ADGroupPolicyChanges", SECURITY, "5136 5137 5141", "C;A;W;T;ObjectClass;GpoName=ObjectDN;AttributeLDAPDisplayName;AttributeValue", value_is("ObjectClass", "groupPolicyContainer", "container"))
_rule("ADGroupPolicyChangesDetailed", SECURITY, DIRECTORY_IDS, "C;A;W;T;ObjectClass;OperationType=optype:OperationType;GpoName=ObjectDN;AttributeLDAPDisplayName;AttributeValue", value_is("ObjectClass", "groupPolicyContainer"))
_rule("ADGroupPolicyEdits", SECURITY, "5136 5137 5141", "C;A;W;T;ObjectClass;OperationType=optype:OperationType;GroupPolicyDisplayName=ObjectDN;AttributeLDAPDisplayName", every(value_is("ObjectClass", "groupPolicyContainer"), value_is("AttributeLDAPDisplayName", "versionNumber")))
_rule("ADGroupPolicyLinks", SECURITY, "5136 5137 5141", "C;W;T;LinkedToType=ObjectClass;OperationType=optype:OperationType;DomainName=DSName;LinkedTo=ObjectDN;GroupPolicies=gpolinks:AttributeValue", every(value_is("ObjectClass", "domainDNS", "organizationalUnit", "site"), value_is("AttributeLDAPDisplayName", "gpLink")), Action=lambda: F.when(source_column("OperationType") == "%%14674", "Group policy link added").when(source_column("OperationType") == "%%14675", "Group policy link deleted").otherwise(F.col("message_subject")))
for _name, _id in (("GpoCreated", "5137"), ("GpoDeleted", "5141")):
    _rule(_name, SECURITY, _id, "C;A;W;T;GpoName=ObjectDN", value_is("ObjectClass", "groupPolicyContainer"))
_rule("GpoModified", SECURITY, "5136", "C;A;W;T;GpoName=ObjectDN;AttributeLDAPDisplayName;AttributeValue", value_is("ObjectClass", "groupPolicyContainer"))
_rule("ADGroupChange", SECURITY, "4735 4737 4745 4750 4760 4764 4784 4791", "C;A;W;T;GroupName=target;GroupTypeChange;SamAccountName;SidHistory", lambda: account(F.col(DATA), "Subject") != "*ANONYMOUS*")
_rule("ADGroupChangeDetailed", SECURITY, DIRECTORY_IDS, f"C;A;W;T;ObjectClass;{CHANGE}", value_is("ObjectClass", "group"), Group=_moved("ObjectDN", "OldObjectDN"), FieldValue=_moved("AttributeValue", "NewObjectDN"))
_rule("ADGroupCreateDelete", SECURITY, "4727 4730 4731 4734 4744 4748 4749 4753 4754 4758 4759 4763", "C;A;W;T;GroupName=target")
_rule("ADGroupEnumeration", SECURITY, "4798 4799", "C;A;W;T;GroupName=target")
_rule("ADGroupMembershipChange", SECURITY, "4728 4729 4732 4733 4746 4747 4751 4752 4756 4757 4761 4762 4785 4786 4787 4788", "C;A;W;T;GroupName=target", MemberName=lambda: D.first_filled(raw(F.col(DATA), "MemberNameWithoutCN"), F.regexp_extract(lookup(F.col(DATA), "MemberName"), r"(?i)^CN=((?:[^,\\]|\\.)+)", 1), raw(F.col(DATA), "MemberName")))
_rule("ADLdapBindingDetails", "Directory Service", "2889", "C;A;T;RemoteEndpoint=NoNameA0;AccountName=NoNameA1;BindType=bind:NoNameA2", RemoteIp=lambda: D.endpoint(source_column("NoNameA0"))["ip"], RemotePort=lambda: D.endpoint(source_column("NoNameA0"))["port"])
_rule("ADLdapBindingSummary", "Directory Service", "2887", "C;A;T;NumberOfSimpleBinds=int:NoNameA0;NumberOfUnsignedBinds=int:NoNameA1")
_rule("ADOrganizationalUnitChangeDetailed", SECURITY, DIRECTORY_IDS, "C;A;W;T;FieldChanged=AttributeLDAPDisplayName", every(value_is("ObjectClass", "organizationalUnit"), missing_or_not("AttributeLDAPDisplayName", "qPLik")), OrganizationalUnit=_moved("ObjectDN", "OldObjectDN"), FieldValue=_moved("AttributeValue", "NewObjectDN"), OperationType=lambda: F.when(text_has("message_subject", "created")(), "Created").when(text_has("message_subject", "deleted")(), "Deleted").when(text_has("message_subject", "moved")(), "Moved").otherwise(source_column("optype:OperationType")))
_rule("ADOtherChangeDetailed", SECURITY, DIRECTORY_IDS, f"C;A;W;T;ObjectClass;{CHANGE}", lambda: ~F.upper(raw(F.col(DATA), "ObjectClass")).isin("USER", "COMPUTER", "ORGANIZATIONALUNIT", "GROUP"), User=_moved("ObjectDN", "OldObjectDN"), FieldValue=_moved("AttributeValue", "NewObjectDN"))
_rule("AADConnectPasswordSyncFailed", APPLICATION, "611", "C;T;Error=join:ErrorCode|FailureCode", User=filled("join:User|AccountName", found(r"(?i)user:?\s+(\S+)")))
_rule("ADSMBServerAuditV1", "Microsoft-Windows-SMBServer/Audit", "3000", "C;A;T;ClientAddress=ClientName", provider("Microsoft-Windows-SMBServer"))
_rule("ADUserChangeDetailed", SECURITY, DIRECTORY_IDS, f"C;A;W;T;ObjectClass;{CHANGE}", value_is("ObjectClass", "user"), User=_moved("ObjectDN", "OldObjectDN"), FieldValue=_moved("AttributeValue", "NewObjectDN"))
_rule("ADUserCreateChange", SECURITY, "4720 4738", f"C;A;W;T;UserAffected=target;{ACCOUNT_FIELDS}")
_rule("ADUserLockouts", SECURITY, "4740", "C;A;W;T;UserAffected=target;CallerComputerName;ComputerLockoutOn=CallerComputerName")
_rule("ADUserLogon", SECURITY, "4624", LOGON)
_rule("ADUserLogonFailed", SECURITY, "4625", "C;A;T;Who=WorkstationName;ObjectAffected=target;IpAddress;IpPort;LogonProcessName;LmPackageName;KeyLength;ProcessId;ProcessName;TransmittedServices;PackageName=AuthenticationPackageName;LogonType=logon:LogonType;Status=status:Status;SubStatus=substatus:SubStatus;FailureReason=reason:FailureReason", FailureDescription=lambda: D.failure_description(source_column("status:Status"), source_column("substatus:SubStatus"), source_column("reason:FailureReason")))
_rule("ADUserLogonNTLMv1", SECURITY, "4624", LOGON + ";LmPackageName;PackageName=AuthenticationPackageName;KeyLength;ProcessId;ProcessName", value_is("LmPackageName", "NTLM V1"))
_rule("ADUserPrivilegeUse", SECURITY, "4672", "C;A;W;T;Privileges=words:PrivilegeList;PrivilegesTranslated=privileges:PrivilegeList")
_rule("ADUserRightsAssignment", SECURITY, "4704 4705", "C;A;W;T;Rights=words:PrivilegeList;RightsTranslated=privileges:PrivilegeList", UserAffected=filled("target", lambda: raw(F.col(DATA), "TargetSid")))
_rule("ADUserStatus", SECURITY, "4722 4725 4723 4724 4726", "C;A;W;T;UserAffected=target")
_rule("ADUserUnlocked", SECURITY, "4767", "C;A;W;T;ComputerLockoutOn=TargetDomainName;UserAffected=target")
for _name, _id in (("AADConnectStagingDisabled", "351"), ("AADConnectStagingEnabled", "350")):
    _rule(_name, APPLICATION, _id, "C;T", Operator=filled("Operator", lambda: source_column("join:SubjectDomainName|SubjectUserName")))
_rule("AADSyncCycleStage", APPLICATION, "904", "C;T", provider("Directory Synchronization"), Stage=lambda: D.sync_stage(_longest()), Connector=lambda: D.text_after(_longest(), "Connector:"), TrackingId=lambda: D.text_after(_longest(), "TrackingId:"), CycleType=lambda: F.when(F.contains(F.lower(_longest()), F.lit("delta")), "Delta").when(F.contains(F.lower(_longest()), F.lit("full")), "Full").otherwise(""))
_rule("AADSyncFilterStatus", APPLICATION, "6952", "C;T", provider("ADSync"), Enabled=lambda: F.contains(F.lower(_longest()), F.lit("enabled")), Connector=lambda: D.text_after(_longest(), "connector"))
_rule("AADSyncImportStatus", APPLICATION, "105 132 133 134", "C;T", provider("Directory Synchronization"), Phase=lambda: F.when(F.col("id") == 105, "Start").when(F.col("id") == 132, "Batch").when(F.col("id") == 133, "Watermark").otherwise("End"), TrackingId=found(r"(?i)TrackingId[:=]\s*([\w-]+)"), SessionId=found(r"(?i)SessionId[:=]\s*([\w-]+)"), WatermarkHash=found(r"(?i)Watermark(?:Hash)?[:=]\s*(\S+)"), PartitionName=found(r"(?i)PartitionName[:=]\s*([^\r\n,;]+)"))
_rule("AADSyncPasswordHashSyncStatus", APPLICATION, "663", "C;T", provider("Directory Synchronization"), PartitionName=found(r"(?i)<partition[^>]*>([^<]+)<"), ConnectorId=found(r"(?i)<connector[^>]*>([^<]+)<"))
_rule("CertificateIssued", SECURITY, "4886 4887", "C;A;W;T;CertificateTemplate=hex:join:CertificateTemplate|CertificateTemplateOid;Requester=hex:join:Requester|RequestSubjectName;SerialNumber=hex:SerialNumber")
_rule("DhcpLeaseCreated", "Microsoft-Windows-DHCP Server/Operational", "10", "C;T;IPAddress=join:IpAddress|ClientIp;MacAddress=join:HwAddress|MacAddress", provider("Microsoft-Windows-DHCP-Server"))
_rule("ExchangeDatabaseMounted", APPLICATION, "9526", "C;T", MailboxDatabase=filled("join:Database|Mailbox Database", found(r"""(?i)database\s+["']([^"']+)["']""")))
_rule("HyperVVirtualMachineStarted", "Microsoft-Windows-Hyper-V-VMMS/Admin", "18500", "C;T;VirtualMachine=join:Name|VMName;VirtualMachineId=join:VMId|VirtualMachineId")
_rule("HyperVCheckpointCreated", "Microsoft-Windows-Hyper-V-VMMS/Admin", "4096", "C;T;VmName=pick:VmName|VMName|Name;CheckpointName=pick:CheckpointName|SnapshotName|NoNameA1;User=pick:User|UserName|SubjectUserName")
_rule("HyperVVirtualMachineShutdown", "Microsoft-Windows-Hyper-V-Worker/Operational", "18560", "C;T;VmName=pick:VmName|VMName|Name;User=pick:User|UserName|SubjectUserName")
_rule("IISSiteBindingFailure", SYSTEM, "1007", "C;T", SiteName=filled("join:SiteName|Site", found(r"""(?i)site\s+["']?([^"'\r\n.]+)""")), Binding=filled("join:BindingInfo|BindingInformation", found(r"""(?i)binding\s+["']?([^"'\s]+)""")))
_rule("IISSiteStopped", SYSTEM, "1005", "C;T", SiteName=filled("join:SiteName|Name", lambda: F.col("message_subject")), User=filled("join:User|UserName", lambda: source_column("subject")))
_rule("KerberosPolicyChange", SECURITY, "4713", "C;W;T;PolicyChanges=kerberos:KerberosPolicyChange")
_rule("KerberosServiceTicket", SECURITY, "4769 4770", "C;A;T;AccountName=target;ServiceName;IpAddress;IpPort;TicketOptions;EncryptionType=encryption:TicketEncryptionType;WeakEncryptionAlgorithm=weak:TicketEncryptionType;UnusualTicketOptions=unusual:TicketOptions", provider(AUDITING))
_rule("KerberosTGTRequest", SECURITY, "4768", "C;A;T;AccountName=target;IpAddress=ip:IpAddress;IpPort;ClientAdvertizedEncryptionTypes;AccountSupportedEncryptionTypes;AccountAvailableKeys;ServiceSupportedEncryptionTypes;ServiceAvailableKeys;DCSupportedEncryptionTypes;DCAvailableKeys;ResponseTicket;TicketOptionsText=optionstext:TicketOptions;StatusText=statustext:Status;TicketEncryptionTypeText=encryptiontext:TicketEncryptionType;PreAuthTypeText=preauthtext:PreAuthType;SessionKeyEncryptionTypeText=encryptiontext:SessionKeyEncryptionType;PreAuthEncryptionTypeText=encryptiontext:PreAuthEncryptionType;WeakEncryptionAlgorithm=weak:TicketEncryptionType", provider(AUDITING))
_rule("KerberosTicketFailure", SECURITY, "4771 4772", "C;A;T;AccountName=target;FailureCode=Status;IpAddress;IpPort;EncryptionType=encryption:TicketEncryptionType;WeakEncryptionAlgorithm=weak:TicketEncryptionType", provider(AUDITING))
_cleared = {"BackupPath": filled("BackupPath", lambda: F.lit("N/A")), "LogType": lambda: D.operation_type(source_column("Channel"))}
_rule("LogsClearedOther", SYSTEM, "104", "C;A;W;T", provider(*EVENT_LOG), **_cleared)
_rule("LogsClearedSecurity", SECURITY, "1102 1105", "C;A;T", provider(*EVENT_LOG), Who=lambda: F.when(F.col("id") == 1105, "Automatic Backup").otherwise(source_column("subject")), **_cleared)
_rule("LogsFullSecurity", SECURITY, "1104", "C;A;W;T;LogType=optype:Channel")
_rule("NetworkAccessAuthenticationPolicy", SECURITY, "6272 6273", "C;A;T;SecurityID=SubjectUserSid;AccountName=SubjectUserName;AccountDomain=SubjectDomainName;CalledStationID;CallingStationID;NASIPv4Address;NASIPv6Address;NASIdentifier;NASPort;NASPortType=nasport:NASPortType;AuthenticationProvider;AuthenticationServer;AuthenticationType=auth:AuthenticationType;EAPType;ClientFriendlyIPAddress=ClientIPAddress;ClientFriendlyName=ClientName;ConnectionRequestPolicyName=ProxyPolicyName;NetworkPolicyName;Reason;ReasonCode;Who=FullyQualifiedSubjectUserName")
_rule("SqlDatabaseCreated", APPLICATION, "17137 1802", "C;T", DatabaseName=filled("join:Database|Database Name", found(r"""(?i)database\s+["']([^"']+)["']""")))
_rule("AuditPolicyChange", SECURITY, "4719", "C;W;T;CategoryId;SubcategoryId;SubcategoryGuid;AuditPolicyChanges")
_rule("BitLockerKeyChange", SECURITY, "4673 4692", "C;A;W;T;Volume=volume:join:VolumeName|Volume;ProtectorType=protector:join:ProtectorType|KeyProtection;MasterKeyId;RecoveryKeyId;RecoveryServer")
_rule("BitLockerSuspended", "BitLocker-API", "24660", "C;W;T;Volume=volume:join:VolumeName|Volume")
_policy = "C;A;W;T;PolicyScope=NoNameA0;ItemName=NoNameA1;PolicyName=join:NoNameA2|ExtensionName;Error=join:NoNameA3|ErrorDescription"
_from_policy = either(provider("Microsoft-Windows-GroupPolicy"), lambda: F.col("log_name") == "Microsoft-Windows-GroupPolicy/Operational")
for _name, _channel, _id in (("ClientGroupPoliciesApplication", APPLICATION, "4098"), ("ClientGroupPoliciesSystem", SYSTEM, "1085")):
    _rule(_name, _channel, _id, _policy, _from_policy, ActionTimestampUtc=lambda: F.col("time_created"))
_rule("DeviceDisabled", SECURITY, "6420", "C;W;T;DeviceId;DeviceName=join:DeviceDescription|DeviceName;ClassId;ClassName;Reason")
_rule("DeviceRecognized", SECURITY, "6416", "C;W;T;DeviceId;DeviceName=join:DeviceDescription|DeviceName;ClassId;ClassName;VendorIds;CompatibleIds;LocationInformation;DeviceType=device:ClassName;Vendor=vendor:VendorIds")
_rule("DfsReplicationError", "DFS Replication", "5002", "T;ReplicationGroup=Replication Group;ErrorCode=join:Error Code|Error;Partner=Partner Name")
_rule("FirewallRuleChange", SECURITY, "4947", "C;A;T;RuleName;ProfileChanged", provider(AUDITING, "Microsoft-Windows-Windows Firewall With Advanced Security"))
_drivers = ("npcap", "npf", "netmon")
_rule("NetworkMonitorDriverLoaded", SYSTEM, "6 7035 7045", "C;T;Driver=pick:DriverName|ServiceName|param1|NoNameA0", either(every(provider("Service Control Manager"), lambda: F.col("id").isin(7035, 7045), text_has("message_subject", *_drivers)), every(provider("Microsoft-Windows-FilterManager"), lambda: F.col("id") == 6, lambda: reduce(lambda a, b: a | b, [F.contains(F.lower(source_column("pick:DriverName|ServiceName|param1|NoNameA0")), F.lit(d)) for d in _drivers]))))
_rule("NetworkPromiscuousMode", SYSTEM, "10400 10401", "C;T;Adapter=join:AdapterName|Name", provider("Ndis"))
_rule("OSBugCheck", SYSTEM, "1001", "C;T;BugCheckCode=join:BugcheckCode|param1;Parameter1=join:BugcheckParameter1|param2;Parameter2=join:BugcheckParameter2|param3;Parameter3=join:BugcheckParameter3|param4;Parameter4=join:BugcheckParameter4|param5;DumpFile;ReportId")
_rule("OSCrash", SYSTEM, "6008", "C", provider(*EVENT_LOG), Action=filled("EventAction", lambda: F.lit("System crash")), When=_os_time)
for _name, _channel, _id, _providers, _label in (
    ("OSCrashOnAuditFailRecovery", SECURITY, "4621", (AUDITING,), "Administrator recovered system from CrashOnAuditFail"),
    ("OSShutdown", SYSTEM, "13", ("Microsoft-Windows-Kernel-General",), "System shutdown"),
    ("OSStartup", SYSTEM, "12", ("Microsoft-Windows-Kernel-General",), "System start"),
    ("OSStartupSecurity", SECURITY, "4608", (), "System start"),
    ("OSUncleanShutdown", SYSTEM, "41", ("Microsoft-Windows-Kernel-Power",), "System restarted without a clean shutdown"),
):
    _rule(_name, _channel, _id, "C", provider(*_providers) if _providers else None, Action=lambda label=_label: F.lit(label), When=_os_time)
_rule("OSTimeChange", SECURITY, "4616", "C;A;W;T;PreviousTime;NewTime")
_rule("ObjectDeletion", SECURITY, "4660", "C;W;T;Path=ObjectName")
_task = lambda tag: lambda: F.trim(F.regexp_extract(source_column("TaskContent"), rf"(?is)<(?:\w+:)?{tag}>(.*?)</", 1))
_rule("ScheduledTaskCreated", SECURITY, "4698", "C;TaskName", Author=_task("Author"), Created=lambda: D.parse_utc(_task("Date")()))
_rule("ScheduledTaskDeleted", SECURITY, "4699", "C;W;T;TaskName")
_rule("SyncCompleted", APPLICATION, "907", "C;T", Statistics=lambda: D.word_counts(F.col("message")))
_rule("WindowsUpdateFailure", "Setup", "20", "C;T;Reason=pick:ErrorDescription|Message", provider("Microsoft-Windows-WindowsUpdateClient"), KB=lambda: F.regexp_extract(F.concat_ws(" ", source_column("UpdateTitle"), F.col("message")), r"(KB\d{6,7})", 1))

#: Rules that one generated method holds.
FEW_RULES = 16
#: A name that may be asked for but has no rule: a request for it yields nothing.
WITHOUT_RULE = {"AADSyncProvisionCredentialsPing"}


def _specs(names: list[str]) -> list[RuleSpec]:
    unknown = [n for n in names if n not in RULES and n not in WITHOUT_RULE]
    if unknown:
        raise ValueError(f"unknown named events {', '.join(unknown)}")
    return [RULES[n] for n in dict.fromkeys(names) if n in RULES]


def scan_plan(names: list[str]) -> dict[str, set[int]]:
    """Channel -> ids of the named events."""
    plan: dict[str, set[int]] = {}
    for rule in _specs(names):
        plan.setdefault(rule.channel, set()).update(rule.ids)
    return plan


def handlers(event_id: int, channel: str) -> list[RuleSpec]:
    return [r for r in RULES.values() if r.channel == channel and event_id in r.ids]


def scan_guard(names: list[str]) -> Column:
    """The plan as a predicate of plain comparisons, for the scan."""
    parts = [(F.col("log_name") == c) & F.col("id").isin(*sorted(ids)) for c, ids in scan_plan(names).items()]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def classify(events: DataFrame, names: list[str]) -> DataFrame:
    """Events of the named ones, with named_event: the first of the names, in their order, whose rule holds."""
    specs = _specs(names)
    if not specs:
        return events.where(F.lit(False)).withColumn("named_event", F.lit(None).cast("string"))
    held = [F.when(r.guard(), F.lit(r.name)) for r in specs]
    rows = events.where(scan_guard(names))
    if len(held) <= FEW_RULES:
        return rows.withColumn("named_event", F.coalesce(*held)).where("named_event is not null")
    # Too much for one generated method: the names that hold are listed, outside of it, and the first is taken. The list is a column of its
    # own, as lookups in a map become what it is made of in a projection, not in an explode.
    first = F.slice(F.filter(F.array(*held), lambda x: x.isNotNull()), 1, 1)
    listed = rows.withColumn("_held", first)
    return listed.withColumn("named_event", F.explode_outer("_held")).where("named_event is not null").drop("_held")


def project(events: DataFrame, name: str) -> DataFrame:
    """The typed projection of one named event."""
    (rule,) = _specs([name])
    head = {"named_event": F.lit(name), "event_id": F.col("id"), "record_id": F.col("record_id"), "gathered_from": F.col("gathered_from") if "gathered_from" in events.columns else F.lit(None).cast("string")}
    return events.where(rule.guard()).select(*[c.alias(k) for k, c in (head | rule.columns()).items()])


def unified(events: DataFrame, names: list[str], keep: tuple[str, ...] | None = None, with_payload: bool = True) -> DataFrame:
    """Classified events in one frame: the heads, who / object_affected / computer / action, and a payload map (of the kept keys)."""
    from ..operators.timeline import payload
    from .profiles import snake_case

    specs = _specs(names)
    rows = classify(events, names)

    def pick(*options: str) -> Column:
        made = [F.when(F.col("named_event") == r.name, r.makers()[k]().cast("string")) for r in specs for k in [next((o for o in r.makers() if o in options), None)] if k]
        return F.coalesce(*made, F.lit(None).cast("string"))

    def fields(rule: RuleSpec) -> dict[str, Column]:
        wanted = {k: f for k, f in rule.makers().items() if keep is None or snake_case(k) in keep}
        return {k: F.to_json(f()) if k in ("PolicyChanges", "Statistics", "GroupPolicies") else f() for k, f in wanted.items()}

    out = rows.select("named_event", F.col("id"), F.col("id").alias("event_id"), "record_id", "time_created", "log_name", "computer_name", pick("Who").alias("who"), pick("ObjectAffected", "UserAffected", "ComputerAffected", "GroupName", "AccountName", "GpoName", "User").alias("object_affected"), F.col("computer_name").alias("computer"), pick("Action").alias("action"), *([F.coalesce(*[F.when(F.col("named_event") == r.name, payload(fields(r), keep)) for r in specs]).alias("payload")] if with_payload and specs else []))
    return out
